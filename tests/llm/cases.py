"""Rows that every operator must handle."""

#: What every operator must handle: nulls, empty, blank, ties, repeats, one very long text, other scripts.
HARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "Same text here with Several words"), (5, "same text here with several words"), (6, "same text here with several words"), (7, "ÄÖ ñandú 漢字 😀 naïve"),
    (8, "word " * 40_000), (9, "x" * 70_000), (10, "1234 5678 !!! ---"), (11, "a"), (11, "a"), (None, "no number on this one"), (None, None), (12, "tab\tand\x0bvertical\x1cfile sep nbsp"),
]
