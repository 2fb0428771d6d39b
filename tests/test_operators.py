import datetime as dt
import io
import logging

import pydantic
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import rollweave as R
from rollweave.log import get_logger
from rollweave.operators.components import connected_components
from rollweave.operators.validation import error_report, report_counts
from rollweave.plans.queries import EventRow

ID = "Student HEAT ID"


@pytest.fixture(scope="module")
def people(spark):
    left = [("Jane Doe", "2008-01-01", "A"), ("Mike Jones", "2009-01-01", "B"), ("Thomas Smith", "2007-01-01", "C"), ("Sarah Brown", "2006-01-01", "D"), ("Christopher Bloggs", "2001-01-01", "E")]
    register = [("#1", "Jane Doe", "2008-01-01", "A"), ("#5", "Jane Doe", "2008-01-01", "A"), ("#3", "Thomas Smith", "2007-01-01", "C"), ("#4", "Sarah Brown", "2006-01-01", "D"), ("#2", "Michael Jones", "2009-01-01", "B")]
    return spark.createDataFrame(left, "name string, dob string, pc string"), spark.createDataFrame(register, f"`{ID}` string, `Full Name` string, born string, post string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(F.col(f"`{c}`") for c in columns)).collect()), key=repr)


def test_exact_match(people):
    left, register = people
    m = R.exact_match(left, register, ["name", "dob"], ["Full Name", "born"], "exact")
    assert m.matched.columns == ["name", "dob", "pc", "Match Type", f"HEAT: {ID}"]
    assert rows(m.matched, "name", f"HEAT: {ID}") == [("Jane Doe", "#1"), ("Jane Doe", "#5"), ("Sarah Brown", "#4"), ("Thomas Smith", "#3")]
    assert rows(m.remaining, "name") == [("Christopher Bloggs",), ("Mike Jones",)]
    full, _ = R.exact_match(left, register, ["name", "dob"], ["Full Name", "born"], "exact", verify=True)
    assert full.columns == ["name", "dob", "pc", "Full Name", "born", f"HEAT: {ID}", "Match Type", "HEAT: Full Name", "HEAT: born", "HEAT: post"]
    assert full.count() == 4


def test_exact_match_nulls(spark):
    left = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "n int, k string")
    register = spark.createDataFrame([("a", None), (None, "x")], f"`{ID}` string, k string")
    m = R.exact_match(left, register, ["k"], ["k"], "nulls")
    assert rows(m.matched, "n", f"HEAT: {ID}") == [(1, "a")]
    assert rows(m.remaining, "n") == [(2,), (3,)]
    assert "CartesianProduct" not in m.matched._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in m.matched._jdf.queryExecution().executedPlan().toString()


def test_exact_match_guards(spark, people):
    left, register = people
    with pytest.raises(TypeError):
        R.exact_match("left", register, ["name"], ["Full Name"], "x")
    with pytest.raises(R.MissingColumnError):
        R.exact_match(left, register, ["Name"], ["Full Name"], "x")
    with pytest.raises(R.MissingColumnError):
        R.exact_match(left, register, ["name"], ["Full Name"], "x", id_col="id")
    with pytest.raises(R.FilterMismatchError):
        R.exact_match(left, register, ["name", "dob"], ["Full Name"], "x")
    with pytest.raises(ValueError):
        R.exact_match(left.withColumn(ID, F.lit(1)), register, ["name"], ["Full Name"], "x")
    with pytest.raises(TypeError):
        R.exact_match(left.withColumn("dob", F.lit(1)), register, ["dob"], ["born"], "x")
    empty = R.exact_match(left.limit(0), register, ["name"], ["Full Name"], "x")
    assert empty.matched.count() == empty.remaining.count() == 0


def test_fuzzy_match(people):
    left, register = people
    m = R.fuzzy_match(left, register, ["dob", "pc"], ["born", "post"], "name", "Full Name", "fuzzy", threshold=70, id_col=ID)
    assert rows(m.matched, "name", f"HEAT: {ID}", "Fuzzy Score") == [("Jane Doe", "#1", 100.0), ("Mike Jones", "#2", 78.26), ("Sarah Brown", "#4", 100.0), ("Thomas Smith", "#3", 100.0)]
    assert rows(m.remaining, "name") == [("Christopher Bloggs",)]
    none = R.fuzzy_match(left, register, ["dob", "pc"], ["born", "post"], "name", "Full Name", "fuzzy", threshold=101, id_col=ID)
    assert none.matched.columns == m.matched.columns and none.matched.count() == 0 and none.remaining.count() == 5
    with pytest.raises(R.FilterMismatchError):
        R.fuzzy_match(left, register, [], [], "name", "Full Name", "fuzzy")
    plan = m.matched._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_fuzzy_nulls_repeats_and_reuse(spark):
    left = spark.createDataFrame([("Jon Smith", "d"), ("Jonathan Smyth", "d"), ("Jon Smith", "d"), ("Jon Smith", None), (None, "d")], "n string, d string")
    register = spark.createDataFrame([("H1", "Jonathan Smith", "d"), ("H2", "Jonathan Smith", None)], f"`{ID}` string, n string, d string")
    m = R.fuzzy_match(left, register, ["d"], ["d"], "n", "n", "f", 70, id_col=ID)
    assert rows(m.matched, "n", f"HEAT: {ID}", "Fuzzy Score") == [("Jon Smith", "H1", 78.26)] * 2 + [("Jonathan Smyth", "H1", 92.86)]
    assert m.remaining.count() == 2 and rows(m.reused(), ID, "matches") == [("H1", 3)]
    out = io.StringIO()
    R.enable_logging("WARNING", stream=out)
    assert m.warn() == 1 and "1 register record" in out.getvalue() and "(H1)" in out.getvalue()
    R.enable_logging("INFO", stream=out)
    assert m.counts() == {"matched": 3, "remaining": 2} and "3 row(s) matched, 2 remain" in out.getvalue()
    none = R.exact_match(left, register.limit(0), ["n"], ["n"], "x")
    assert none.warn() == 0


def test_school_age(spark):
    left = spark.createDataFrame([("Jon Smith", "green  abbey", "10"), ("Jane D.", "Blue Ridge", "Year 10"), ("Jon Smith", None, "10"), ("Jon Smith", "Green Abbey", "Level 2")], "n string, s string, yg string")
    register = spark.createDataFrame([(101, "John Smith", "Green Abbey", "2010-10-01"), (102, "Jane Doe", "Blue Ridge", "2011-08-31"), (103, "Jon Smith", "Green Abbey", "2011-09-01")], f"`{ID}` int, n string, s string, dob string")
    m = R.school_age_match(left, register, "s", "s", "n", "n", "yg", "dob", "age", academic_year_start=2025)
    assert rows(m.matched, "n", "s", f"HEAT: {ID}", "Fuzzy Score") == [("Jane D.", "Blue Ridge", 102, 80.0), ("Jon Smith", "green  abbey", 101, 94.74)]
    assert m.remaining.count() == 2
    with pytest.raises(TypeError):
        R.school_age_match(left, register.withColumn("dob", F.lit(1)), "s", "s", "n", "n", "yg", "dob", "age")


def test_waterfall(people):
    left, register = people
    first = R.exact_match(left, register, ["name", "dob"], ["Full Name", "born"], "exact", verify=True)
    second = R.fuzzy_match(first.remaining, register, ["dob", "pc"], ["born", "post"], "name", "Full Name", "fuzzy", 70, id_col=ID)
    assert rows(R.waterfall(first, second), "name", "Match Type") == [("Jane Doe", "exact")] * 2 + [("Mike Jones", "fuzzy"), ("Sarah Brown", "exact"), ("Thomas Smith", "exact")]


def found(spark, data, **options):
    df = spark.createDataFrame(data, "name string, dob string, pc string").coalesce(1)
    return {r["Duplicate ID"]: r["Potential Duplicates"] for r in R.find_duplicates(df, "name", "dob", "pc", **options).collect()}


def test_duplicates(spark):
    two = [("John Smith", "1", "a"), ("John Smith", "1", "b")]
    assert found(spark, two, fuzzy_type="strict") == {"#1": None, "#2": None}
    assert found(spark, two) == {"#1": "#1, #2", "#2": "#1, #2"}
    twins = [("Robert Smith", "1", "a"), ("Thomas Smith", "1", "a")]
    assert set(found(spark, twins, threshold=40).values()) == {None}
    assert set(found(spark, twins, threshold=40, twin_protection=False).values()) == {"#1, #2"}
    chain = [("Alpha", "1", "a"), ("Alphe", "1", "b"), ("Alphi", "1", "c"), ("Alpha", "2", "a")]
    assert found(spark, chain, threshold=70) == {"#1": "#1, #2, #3", "#2": "#1, #2, #3", "#3": "#1, #2, #3", "#4": None}
    assert set(found(spark, [(" John   Smith", "1", "a"), ("John Smith", " 1 ", "a")], threshold=100).values()) == {"#1, #2"}
    assert set(found(spark, [("John Smith", None, "a"), ("John Smith", "", "a")]).values()) == {None}
    assert found(spark, []) == {}


def test_duplicates_columns_and_guards(spark):
    df = spark.createDataFrame([("B2", "Jane", "Doe", "1", "a", 5), ("A1", "Janie", "Doe", "1", "b", 6), ("C", None, "Doe", "3", "b", 7)], "id string, first string, last string, dob string, pc string, extra int")
    out = R.find_duplicates(df, ["first", "last"], "dob", "pc", id_col="id")
    assert out.columns == [*df.columns, "Potential Duplicates"]
    assert rows(out, "id", "Potential Duplicates") == [("A1", "A1, B2"), ("B2", "A1, B2"), ("C", None)]
    in_order = R.find_duplicates(df, ["first", "last"], "dob", "pc", id_col="id", ordered=True)
    assert [tuple(r) for r in in_order.select("id", "Potential Duplicates").collect()] == [("B2", "A1, B2"), ("A1", "A1, B2"), ("C", None)]
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    for bad, error in (({"threshold": 101}, ValueError), ({"fuzzy_type": "odd"}, ValueError), ({"id_col": "nope"}, R.MissingColumnError)):
        with pytest.raises(error):
            R.find_duplicates(df, "first", "dob", "pc", **bad)
    with pytest.raises(R.RowIdentityError):
        R.find_duplicates(df.withColumn("id", F.lit(1)), "first", "dob", "pc", id_col="id", check_ids=True)


def test_hot_blocks_are_dealt_to_many_tasks(spark, monkeypatch):
    from rollweave.operators import blocks

    left = spark.createDataFrame([(i, "hot" if i % 3 else f"b{i}") for i in range(60)] + [(99, None)], "u int, k string")
    right = left.withColumnsRenamed({"u": "v", "k": "kr"})
    plain = rows(left.join(right, (F.col("k") == F.col("kr")) & (F.col("u") < F.col("v"))), "u", "v")
    for limit in (1, 7, 1000):
        met = blocks.pairs_in_blocks(left, right, ["k"], ["kr"], F.col("u") < F.col("v"), "u", limit)
        assert met.columns == ["u", "k", "v", "kr"] and rows(met, "u", "v") == plain
    data = [(f"Ann{i:02d} Smith", "1", str(i)) for i in range(30)]
    whole = found(spark, data, threshold=85)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    assert found(spark, data, threshold=85) == whole and len(set(whole.values())) >= 1


def test_components_against_union_find(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def test_updates(spark):
    df = spark.createDataFrame([(None, None), ("A", None), (None, "B"), ("  ", "B"), ("A", "A"), ("B", "A")], "new string, old string").coalesce(1)
    assert [r[0] for r in df.select(R.get_updates(df, "new", "old")).collect()] == [None, "A", None, None, None, "B"]
    assert [r[0] for r in df.select(R.get_contextual_updates(df, "new", "old", {"A"})).collect()] == [None] * 5 + ["B"]
    assert [r[0] for r in df.select(R.get_contextual_updates(df, "new", "old", [])).collect()] == [None, "A", None, None, None, "B"]
    n = spark.createDataFrame([(1, "1"), (2, "x"), (None, "3")], "new int, old string").coalesce(1)
    out = n.select(R.get_updates(n, "new", "old").alias("u"))
    assert out.schema["u"].dataType == T.IntegerType() and [r[0] for r in out.collect()] == [None, 2, None]
    with pytest.raises(TypeError):
        R.get_contextual_updates(df, "new", "old", "A")
    with pytest.raises(TypeError):
        R.get_updates(df, 1, "old")
    with pytest.raises(R.MissingColumnError):
        R.get_updates(df, "New", "old")
    both = R.with_updates(df.withColumnRenamed("old", "HEAT: new"), ["new"])
    assert both.columns[-1] == "Update: new"


def test_snake_case(spark):
    for name, want in {"LAST   NAME": "last_name", "FirstName": "first_name", "Cost ($)": "cost", "Total-Amount": "total_amount", "Date of Birth (dd/mm/yyyy)": "date_of_birth_ddmmyyyy"}.items():
        assert R.snake_case(name) == want
    df = spark.createDataFrame([(1, 2)], "`My Col` int, `My  Col` int")
    with pytest.raises(R.ColumnClashError):
        R.snake_case_columns(df)
    assert R.snake_case_columns(df.select("My Col")).columns == ["my_col"]


def test_validation(spark):
    df = spark.createDataFrame([(1, "view", 5.0), (2, "purchase", 0.5), (3, None, None), (4, "purchase", 60.0)], "id int, event_type string, value double")
    out = error_report(df, EventRow)
    assert [tuple(r)[3:] for r in out.orderBy("id").collect()] == [
        (0, None, "Valid"), (2, "'value': too small; 'Model Error': cheap purchase", "Invalid"), (1, "'value': too small", "Invalid"), (0, None, "Valid"),
    ]
    assert tuple(report_counts(out).first()) == (4, 2, 3)
    assert error_report(df.limit(0), EventRow).count() == 0
    cleaned = error_report(df, EventRow, cleaned=T.StructType([T.StructField("value", T.DoubleType())]))
    assert [r.cleaned and r.cleaned.value for r in cleaned.orderBy("id").collect()] == [5.0, None, None, 60.0]
    for bad in (EventRow({}), "x"):
        with pytest.raises(TypeError):
            error_report(df, bad)
    with pytest.raises((TypeError, ImportError)):
        error_report(df, dict)


def test_validation_with_pydantic(spark):
    # made here, so that workers get the class itself and need not import this file
    Person = pydantic.create_model("Person", name=(str, ...), age=(int, ...), score=(float | None, 0.5), created_at=(dt.date | None, None))
    when = dt.datetime(2024, 5, 6, 7, 8)
    df = spark.createDataFrame([("Ann", "25", when, 1), ("Bob", "old", when, 2), (None, "7", None, 3)], "name string, age string, created_at timestamp, extra int")
    out = error_report(df, Person).orderBy("extra").collect()
    # a time of day is no date for the model, but every timestamp comes back as a date
    assert [r.val_error_count for r in out] == [1, 2, 1] and out[0].created_at == dt.date(2024, 5, 6)
    df = df.withColumn("created_at", F.col("created_at").cast("date"))
    raw = error_report(df, Person).orderBy("extra").collect()
    assert [(r.age, r.val_error_count, r.validation_status) for r in raw] == [("25", 0, "Valid"), ("old", 1, "Invalid"), ("7", 1, "Invalid")]
    assert raw[1].val_error_details.startswith("'age': ") and raw[2].val_error_details.startswith("'name': ")
    placed = error_report(df, Person, in_place=True)
    assert dict(placed.dtypes) == {"name": "string", "age": "bigint", "created_at": "date", "extra": "int", "score": "double", "val_error_count": "int", "val_error_details": "string", "validation_status": "string", "val_raw_values": "string"}
    rows_ = placed.orderBy("extra").collect()
    assert [(r.name, r.age, r.created_at, r.extra, r.score) for r in rows_] == [("Ann", 25, when.date(), 1, 0.5), ("Bob", None, when.date(), 2, None), (None, 7, None, 3, None)]
    assert '"age": "old"' in rows_[1].val_raw_values and rows_[0].val_raw_values is None
    assert error_report(df.limit(0), Person, in_place=True).count() == 0
    with pytest.raises(TypeError):
        error_report(df, EventRow, in_place=True)


def test_files(spark, tmp_path):
    for n in ("b.XLSX", "a.xls", "c.csv"):
        (tmp_path / n).write_text("k,v\n1,2\n")
    (tmp_path / "d.xlsx").mkdir()
    assert [p.rsplit("/", 1)[1] for p in R.excel_files(str(tmp_path))] == ["a.xls", "b.XLSX"]
    from rollweave.sources.files import remote_excel_files

    assert len(remote_excel_files(spark, str(tmp_path))) == 2
    with pytest.raises(FileNotFoundError):
        R.excel_files(str(tmp_path / "none"))
    (tmp_path / "e.csv").write_text("k,w\n3,4\n")
    both = R.read_csv(spark, [str(tmp_path / "c.csv"), str(tmp_path / "e.csv")])
    assert both.columns == ["k", "v", "w"] and rows(both, "k", "v", "w") == [("1", "2", None), ("3", None, "4")]


def workbook(path, rows, shared=(), formats="", styles="", sheet="Data"):
    """A workbook in the form that spreadsheet programs write; ``rows``: XML of the sheet's rows."""
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" r:id="rId2"/><sheet name="{sheet}" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>',
        "xl/worksheets/a.xml": f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/b.xml": f"<worksheet {main}><sheetData/></worksheet>",
        "xl/sharedStrings.xml": f"<sst {main}>{''.join(shared)}</sst>",
        "xl/styles.xml": f"<styleSheet {main}><numFmts>{formats}</numFmts><cellXfs>{styles}</cellXfs></styleSheet>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)


def test_excel(spark, tmp_path):
    shared = ["<si><t>Name</t></si>", "<si><r><t>Ja</t></r><r><t>ne</t></r><rPh><t>no</t></rPh></si>", "<si><t>Born</t></si>"]
    formats, styles = '<numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.0&quot; days&quot;"/>', "".join(f'<xf numFmtId="{n}"/>' for n in (0, 164, 14, 165))
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>2</v></c><c r="D2" t="inlineStr"><is><t>N &amp; M</t></is></c></row>'
    body = '<row><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>43831</v></c><c r="D3"><v>2.5</v></c></row><row r="4"/><row><c r="A5" t="b"><v>1</v></c><c r="B5" s="2"><v>43831.5</v></c><c r="C5" s="3"><v>7</v></c></row>'
    workbook(tmp_path / "a.xlsx", '<row r="1"/>' + head + body + '<row><c t="str"><v>f</v></c><c t="e"><v>#N/A</v></c></row>', shared, formats, styles)
    workbook(tmp_path / "b.XLSX", '<row><c t="inlineStr"><is><t>Born</t></is></c><c t="inlineStr"><is><t>Extra</t></is></c></row>' + "".join(f"<row><c><v>{i}</v></c></row>" for i in range(2500)))
    one = R.read_excel(spark, str(tmp_path / "a.xlsx"), sheet="Data")
    assert one.columns == ["Name", "Born", "Unnamed: 2", "N & M"]
    assert [tuple(r) for r in one.collect()] == [("Jane", "2020-01-01 00:00:00", None, "2.5"), ("True", "2020-01-01 12:00:00", "7", None), ("f", None, None, None)]
    both = R.read_excel(spark, R.excel_files(str(tmp_path)), sheet=1)
    assert both.columns == ["Name", "Born", "Unnamed: 2", "N & M", "Extra"] and both.count() == 2503
    assert both.where("Born = '2499' AND Name IS NULL").count() == 1
    with pytest.raises(Exception, match="no sheet 'x'"):
        R.read_excel(spark, str(tmp_path / "a.xlsx"), sheet="x")
    with pytest.raises(ValueError):
        R.read_excel(spark, [])
    workbook(tmp_path / "c.xlsx", "<row>" + '<c t="inlineStr"><is><t>A</t></is></c>' * 2 + "</row>")
    with pytest.raises(R.ColumnClashError):
        R.read_excel(spark, str(tmp_path / "c.xlsx"), sheet="Data")
    empty = R.read_excel(spark, str(tmp_path / "c.xlsx"), sheet="Other")
    assert empty.columns == [] or empty.count() == 0


def test_logging():
    first, out = io.StringIO(), io.StringIO()
    R.enable_logging("debug", stream=first)
    logger = R.enable_logging("INFO", stream=out)
    logger.info("once")
    logger.debug("never")
    get_logger("own").warning("below")
    assert first.getvalue() == "" and out.getvalue() == "INFO rollweave: once\nWARNING rollweave.own: below\n"
    assert len(logger.handlers) == 1 and not logger.propagate
    other = logging.NullHandler()
    logger.addHandler(other)
    with pytest.raises(ValueError):
        R.enable_logging("LOUD")
    R.enable_logging(logging.ERROR, fmt="%(message)s!", stream=out)
    logger.error("short")
    assert out.getvalue().endswith("below\nshort!\n")
    assert R.disable_logging().propagate and logger.level == logging.NOTSET and logger.handlers == [other]
    logger.removeHandler(other)


def test_counts_cost_no_job(spark):
    out = io.StringIO()
    df = spark.createDataFrame([("JANE",), ("Bob",), (None,), ("x",)], "name string")
    done, counts = R.cleaned(df, "name", R.format_postcode, errors="coerce")
    assert done.columns == ["name"] and [r[0] for r in done.collect()] == [None] * 4
    assert counts.get() == {"rows": 4, "changed": 3, "made_null": 3, "null_before": 1}
    R.enable_logging("WARNING", stream=out)
    counts.log()
    assert out.getvalue() == ""
    R.enable_logging("INFO", stream=out)
    counts.log()
    assert out.getvalue() == "INFO rollweave: format_postcode of 'name' over 4 rows; changed 3; made null 3; null before 1\n"


def test_typed_errors(spark):
    for value, by, kind in (("123", R.format_postcode, R.PostcodeError), ("FE Level 3", R.clean_year_group, R.FurtherEducationError), ("what", R.parse_year_group, R.YearGroupError)):
        with pytest.raises(kind, match=value), R.typed_errors():
            spark.createDataFrame([(value,)], "x string").select(by("x")).collect()
    with pytest.raises(R.YearGroupError), R.typed_errors():
        spark.createDataFrame([(dt.date(1990, 1, 1),)], "x date").select(R.year_group_from_date("x", 2025)).collect()
    with pytest.raises(ZeroDivisionError), R.typed_errors():
        1 / 0


def test_shared_folder(spark, monkeypatch):
    from rollweave.plans import session

    class Context:
        applicationId, master = "a", "spark://host"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)
    Context.master = "local[2]"
    assert session.shared_folder(Session) == session.shared_folder(Session) != ""
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert session.shared_folder(Session) == "hdfs://x/y"


def test_validation_is_lazy():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, rollweave; sys.exit('pydantic' in sys.modules or 'rollweave.operators.validation' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0
