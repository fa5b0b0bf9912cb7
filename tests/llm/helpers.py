"""Rows for the tests."""

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, score double, _id int"


def document(i, text, source="a"):
    return (i, text, None, source, None, "x", None, 1)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
