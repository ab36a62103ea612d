"""Rows and paths that several tests of the training-data operators use."""

SF = "/root/testdata/sf0.001"
_CLEAN = "The river runs through the old town and the people walk along its banks in the evening. "
# doc_id, text, lang, source, n_chars
ODD_STAGE = [
    (900000, None, None, None, 0),
    (900001, "", "en", "s", 0),
    (900002, "12345 ... 678", "en", "s", 13),
    (900003, _CLEAN + "A bridge was built there long ago by the farmers of the valley.", "en", "s", 150),
    (900003, _CLEAN + "A bridge was built there long ago by the farmers of the valley.", "en", "s", 150),
    (900004, " ".join(f"{_CLEAN}Page {n} of the book tells about the harvest of that year." for n in range(2000)), "en", None, 300000),
    (None, "Nobody knows when the market opened, but the traders came from every village around the lake.", "en", "s", 95),
]


def rows_of(df) -> int:
    return df.count()
