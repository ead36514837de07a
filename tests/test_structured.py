import zlib

from ledgerloom.sources import structured as S

UBL = "<Invoice><ID>R1</ID></Invoice>"


def test_root_after_a_long_prologue(spark):
    long = "<?xml version='1.0'?>\n<!-- " + "<CrossIndustryInvoice> " * 1000 + "-->\n<!DOCTYPE Invoice>"
    rows = [(1, long + UBL), (2, long + "<r:CrossIndustryInvoice/>"), (3, UBL), (4, "<Order><Invoice/></Order>"), (5, None), (6, "<InvoiceLine/>")]
    got = {r.i: (r.vocabulary, r.number) for r in S.mapped(spark.createDataFrame(rows, "i int, xml string")).collect()}
    assert got == {1: ("ubl", "R1"), 2: ("cii", None), 3: ("ubl", "R1"), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_a_stream_over_the_limit_is_an_issue(spark):
    stream = lambda text: b"stream\n" + zlib.compress(text.encode()) + b"\nendstream "
    pdf = stream(UBL) + stream("<Invoice>" + "x" * S.MAX_INFLATED + "</Invoice>")
    got = spark.createDataFrame([(pdf,), (None,)], "content binary").select(S.embedded_xml("content").alias("x")).collect()
    assert [(e.xml, e.issue is None) for e in got[0].x] == [(UBL, True), (None, False)] and got[1].x == []
