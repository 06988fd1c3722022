"""Rows that are hard for every operator."""

SF = "/root/testdata/sf0.001"

#: Rows that are hard for every operator, with columns that clash with working names.
HARD = [
    (1, "plain words here", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, " \t\n ", "en", "b"), (5, "plain  words\there", "en", "a"),
    (6, "x" * 200_000, "en", "b"), (7, "word " * 60_000, "en", "c"), (7, "word " * 60_000, "en", "c"), (None, "no identifier", "en", "a"), (None, None, None, None),
    (8, "<|endoftext|> ünïcode ½ 漢字   '’s don't", "de", "a"), (9, "you are an idiot. I will hurt you!", "en", "a"), (10, "one two", "en", "\U0001f600"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
