"""DataFrame-to-DataFrame operators over intervals, reads, mutations and tables."""
