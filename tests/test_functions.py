import pytest
from pyspark.sql import functions as F

from clausebase.functions import dates, refs, text, urls


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_dates(spark):
    cases = {
        "07.04.2016": "2016-04-07", "28-11-2012": "2012-11-28", "09/10/2017": "2017-10-09", "5 Oct 2014": "2014-10-05", "5 October 2014": "2014-10-05", "5 Oct, 2014": "2014-10-05", "21st July 2013": "2013-07-21",
        "Signed on 30.09.2015": "2015-09-30", "the order of 22nd May 2011 stays in force": "2011-05-22", "01.01.20": "2020-01-01", "01.01.70": "1970-01-01", "35.13.2019": None, "": None, None: None, "no date here": None, "35.13.2019 or 4 Sept 2001": "2001-09-04", "29.02.2019": None, "29.02.2020": "2020-02-29",
    }
    assert column(spark, list(cases), dates.parse_date) == list(cases.values())


def test_document_ref(spark):
    cases = [
        ("Office of Lamps\nNo. LM-II/2014/31/7    Harbour Town, dated 17.10.2014", "LM-II/2014/31/7", "17.10.2014", "2014-10-17"),
        ("F.No. LMP/52/2016/8-Part(3)\nDated: 24th May 2016", "LMP/52/2016/8-Part(3)", "24th May 2016", "2016-05-24"),
        ("The no. of lamps in a hall is to be kept below forty.", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
        ("lamp " * 400 + "No. LM-I/2014/2/3 dated 17.10.2014", None, None, None),
        ("No.LM-I/2013/40/2 Harbour Town, dt.06.02.2013", "LM-I/2013/40/2", "06.02.2013", "2013-02-06"),
        ("A platform has a length of 7.4 chains at least.", None, None, None),
        ("N o.QX/77/2015/LMP dt.18.11.2015", "QX/77/2015/LMP", "18.11.2015", "2015-11-18"),
    ]
    got = column(spark, [c[0] for c in cases], refs.document_ref)
    assert [(x.number, x.date_raw, x.date_parsed) for x in got] == [c[1:] for c in cases]


def test_references(spark):
    cases = [
        ("These rules come in supersession of Harbour Circular No. 12 of 2011 dated 09.09.2011.", [("supersession", "12", "2011", "09.09.2011", None)]),
        ("In partial modification of Circular No.31/2012 dated 08-02-2012", [("partial_modification", "31/2012", None, "08-02-2012", None)]),
        ("In partial modification of Clause 6 of Circular No. LM-I/2012/8 dated 03.04.2012", [("partial_modification", "LM-I/2012/8", None, "03.04.2012", "6")]),
        ("It amends Para 8.1 of Circular No. 14 of 2013 dated 16.07.2013", [("amendment", "14", "2013", "16.07.2013", "8.1")]),
        ("The board amends the lamp rules of last spring", [("amendment", None, None, None, None)]),
        ("In continuation of letter no. LM-II/2015/3 dated 11th August 2015", [("continuation", "LM-II/2015/3", None, "11th August 2015", None)]),
        ("explains how lamps are paid for", []),
        (None, []),
    ]
    for (_, want), got in zip(cases, column(spark, [c[0] for c in cases], refs.references), strict=True):
        assert [(r.relation, r.referenced_number, r.referenced_year, r.referenced_date_raw, r.referenced_clause) for r in got] == want
    both = column(spark, ["In partial modification of Circular No. 7 dated 01.01.2019. In supersession of Circular No. 8."], refs.references)[0]
    assert [r.relation for r in both] == ["supersession", "partial_modification"]
    assert both[0].matched_sentence == "In supersession of Circular No. 8."


def test_normal_forms(spark):
    assert column(spark, ["TC-I/2019/1", " .", None], refs.normal_number) == ["tci20191", None, None]
    assert column(spark, ["(A)", "4.1.", " ", None], refs.normal_clause) == ["a", "4.1", None, None]


def test_clause_start(spark):
    cases = {"7. Lamps are lit": "7", "2.9 Oil for": "2.9", "(c) wicks": "(c)", "(vi) glass": "(vi)", "Clause 8.4 holds": "8.4", "Lamps go out": None, "2012 saw": "2012"}
    assert column(spark, list(cases), text.clause_ref) == list(cases.values())


def test_paragraphs_and_words(spark):
    assert column(spark, ["Oil first.\n\nWicks next.\n \nGlass last.", "  "], lambda c: text.paragraphs(c)) == [["Oil first.", "Wicks next.", "Glass last."], []]
    assert column(spark, ["a b\tc d", ""], text.word_count) == [4, 0]
    assert column(spark, ["One. Two; three: Four"], text.sentences) == [["One.", "Two; three:", "Four"]]


def test_formatting(spark):
    one = spark.range(1)
    label = lambda a, b: one.select(text.page_label(F.lit(a).cast("int"), F.lit(b).cast("int"))).first()[0]
    assert [label(None, None), label(0, 3), label(2, 2), label(2, None), label(2, 5)] == ["unknown", "unknown", "2", "2", "2-5"]
    line = lambda s, n: one.select(text.status_line(F.lit(s), F.lit(n))).first()[0]
    assert line("superseded", "X") == "Status: SUPERSEDED by X\n" and line("amended", "X") == "Status: AMENDED by X\n"
    assert line("ambiguous", "X") == "Status: AMBIGUOUS -- X\n" and line("current", "X") == "" and line("amended", None) == ""
    assert column(spark, ['A > B/C: "x"', " > ", "p" * 90], text.safe_path) == ["A/B_C_ _x_", "misc", "p" * 80]
    assert one.select(text.safe_filename(F.lit('a/b "c"'), F.lit("0123456789"), F.lit("pdf"))).first()[0] == "a_b _c__01234567.pdf"
    assert one.select(text.breadcrumb(F.lit("Root"), F.lit(""), F.lit("1,2"))).first()[0] == "Root > section-1,2"
    assert column(spark, ["Please list  all rules", "all circulars", "what is the fee?"], text.is_exhaustive) == [True, True, False]
    assert one.select(text.conversational_query(F.lit("q"), F.lit("p")), text.conversational_query(F.lit("q"), F.lit(None).cast("string"))).first() == ("p\nq", "q")


def test_message(spark):
    schema = "rank int, title string, date string, circular_number string, section_path string, clause_ref string, page_start int, page_end int, status string, status_note string, source_url string, text string"
    hits = spark.createDataFrame([(2, "B", "", "", "S", "", None, None, "current", "", "u2", "two"), (1, "A", "2020-01-01", "N1", "S", "4", 1, 2, "amended", "by N2", "u1", "one")], schema)
    got = text.user_message("why?", hits).first()[0]
    assert got.startswith("Retrieved excerpts:\n\n[Excerpt 1]\nTitle: A\nDate: 2020-01-01\nNotification/Letter No.: N1\nSection: S\nClause: 4\nPage: 1-2\nStatus: AMENDED by by N2\nSource URL: u1\n---\none\n\n\n[Excerpt 2]\nTitle: B\nDate: unknown")
    assert got.endswith("Question: why?")
    assert text.user_message("why?", hits.limit(0)).first()[0] == "Question: why?\n\nNo retrieved excerpts were found in the knowledge base for this question."


@pytest.mark.parametrize(("base", "href"), [("http://h/a/b?x=1", h) for h in ("c.pdf", "/d/e", "?y=2", "../f", "./g/../k.doc", "http://z/q", "//w/p", "c?id=1,2#t")])
def test_resolved(spark, base, href):
    from urllib.parse import urljoin

    assert spark.range(1).select(urls.resolved(F.lit(base), F.lit(href))).first()[0] == urljoin(base, href)


def test_links(spark):
    html = """<a href="x.PDF">Doc <b>1</b></a><a class=q href='view_section.jsp?lang=0&amp;id=0,1,2'> Menu </a><a href="javascript:x()">no</a><a href="#top">no</a><a name=z>no</a>"""
    got = column(spark, [html], urls.links)[0]
    assert [(x.href, x.text) for x in got] == [("x.PDF", "Doc 1"), ("view_section.jsp?lang=0&id=0,1,2", "Menu")]
    assert column(spark, ["http://h/v?lang=0&id=0%2C1,2", "http://h/v?lang=0"], urls.menu_id) == ["0,1,2", None]
    assert column(spark, ["http://h/a.PDF?x=1", "http://h/a.docx", "http://h/pdf"], urls.doc_type) == ["pdf", "docx", "unknown"]
    assert column(spark, ["http://h/a.PDF?x=1", "http://h/?f=a.pdf"], urls.is_document_link) == [True, False]
    assert column(spark, ["0,1", "0,1,5", "0,12"], lambda c: urls.in_scope(c, "0,1")) == [True, True, False]
    assert column(spark, ["http://old.example/a", "http://new.example/a", "https://old.example/a"], lambda c: urls.normal_scheme(c, ["old.example"])) == ["https://old.example/a", "http://new.example/a", "https://old.example/a"]
    assert column(spark, ["<title> T\nx </title>", "<h1>H</h1>", "none"], lambda c: urls.page_title(c, F.lit("9"))) == ["T x", "H", "section-9"]
    assert spark.range(1).select(dates.nearby_date(F.lit("none"), F.lit("on 05.09.2022 and 1.1.2020"))).first()[0] == "05.09.2022"


def test_spaces_and_digits_of_other_scripts(spark):
    """Non-breaking and other Unicode spaces, and Devanagari digits, are read as plain ones are."""
    plain = ["No. TC-I/2019/1 dated 12.06.2019", "In supersession of Circular No. 45/2019 dated 3rd March 2020", "Para 4.2 Fees of the first class.\n \nNext one", "in partial modification of Clause 4.2 of letter No. 9/2017 of 2018"]
    detected = lambda c: F.struct(refs.document_ref(c).alias("own"), F.transform(refs.references(c), lambda r: r.withField("referenced_date_raw", F.regexp_replace(r["referenced_date_raw"], r"(?U)\s", " ")).dropFields("matched_sentence")).alias("refs"), text.clause_ref(c).alias("clause"), F.size(text.paragraphs(c)).alias("n"))
    for space in ("\u00a0", "\u2009", "\u202f", "\u3000"):
        rows = spark.createDataFrame([(p, p.replace(" ", space)) for p in plain], "a string, b string").select(detected(F.col("a")).alias("a"), detected(F.col("b")).alias("b")).collect()
        assert [r.a.refs for r in rows] == [r.b.refs for r in rows] and [r.a.clause for r in rows] == [r.b.clause for r in rows] and [r.a.n for r in rows] == [r.b.n for r in rows]
        assert [(r.a.own.number, r.a.own.date_parsed) for r in rows] == [(r.b.own.number, r.b.own.date_parsed) for r in rows]
        assert [len(r.b.refs) for r in rows] == [0, 1, 0, 1]
    got = spark.createDataFrame([("१२.०६.२०१९",), ("1st Jan 2020",)], "t string").select(dates.parse_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == ["2019-06-12", "2020-01-01"]
