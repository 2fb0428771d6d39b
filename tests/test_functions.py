import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import rollweave as R
from rollweave.functions.text import title


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    out = [tuple(r) for r in df.coalesce(1).select(*columns).collect()]
    return [r[0] for r in out] if len(columns) == 1 else out


def test_format_name_examples(spark):
    pairs = {
        "JANE DOE": "Jane Doe", "Jane - Jane Doe": "Jane-Jane Doe", " Jane   Doe ": "Jane Doe", "mcdonald": "McDonald",
        "o'connor-mcdonald": "O'Connor-McDonald", "JANE'S SMITH": "Jane's Smith", "o'b": "O'B", "D'ARCY": "D'Arcy", "": "",
    }
    assert values(spark, [*pairs, None], "string", R.format_name("x")) == [*pairs.values(), None]


def reference_name(text):
    """The rule in words: title case, tight hyphens, single spaces, lone capitals after apostrophes, Mc."""
    t = re.sub(r"\s+", " ", re.sub(r"\s*-\s*", "-", text.strip().title()))
    t = re.sub(r"(?<!\bO)'([A-Z])\b", lambda m: m.group(0).lower(), t)
    return re.sub(r"\bMc[a-z]", lambda m: m.group(0)[:2] + m.group(0)[2].upper(), t)


def test_names_against_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBc dO'McC-Éßñø  \tﬁ’1") for _ in range(rng.randrange(14))) for _ in range(1500)]
    assert values(spark, texts, "string", title("x")) == [t.title() for t in texts]
    assert values(spark, texts, "string", R.format_name("x")) == [reference_name(t) for t in texts]


def test_diacritics_against_unicodedata(spark):
    rng = random.Random(5)
    pool = "éÀñüß Łø²½ﬁ한글ﬃ’ááxŒÅ㎏Ａ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(400)] + ["", None]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn") for t in texts]
    assert values(spark, texts, "string", R.remove_diacritics("x")) == want


def test_diacritics_without_python(spark):
    df = spark.createDataFrame([("Crème",)], "x string").select(R.remove_diacritics("x", exact=False))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first()[0] == "Creme"


def test_numbers(spark):
    assert values(spark, ["Jane", "J4ne", None], "string", R.find_numbers("x")) == [False, True, None]
    assert values(spark, ["Jane", None], "string", R.find_numbers("x", convert_to_string=True)) == [False, False]
    assert values(spark, ["1 Jane Doe 79", "  23 Jane", "Jane 5 Doe", " no "], "string", R.remove_numbers("x")) == ["Jane Doe", "Jane", "Jane  Doe", " no "]


def test_punctuation(spark):
    assert values(spark, ["word...word", "123,456!", "O'Neil-Smith"], "string", R.remove_punctuation("x")) == ["word word", "123 456", "O'Neil-Smith"]
    assert values(spark, ["user@host!"], "string", R.remove_punctuation("x", "@")) == ["user host!"]


def test_full_name(spark):
    df = spark.createDataFrame([("Jane", "Doe", "Middle"), (" Jane ", " Doe", "  "), (None, "NaN", None), ("nan", "Doe", None)], "f string, l string, m string")
    assert [r[0] for r in df.select(R.full_name("f", "l", "m")).collect()] == ["Jane Middle Doe", "Jane Doe", None, "Doe"]


def test_unknown_mode():
    with pytest.raises(ValueError):
        R.format_name("x", errors="maybe")


def test_postcodes(spark):
    raw = ["st55bg", "sw1a1aa", " ec1a 1bb", "ABC1 1AA", "123", None]
    assert values(spark, raw, "string", R.format_postcode("x", errors="coerce")) == ["ST5 5BG", "SW1A 1AA", "EC1A 1BB", None, None, None]
    assert values(spark, raw, "string", R.format_postcode("x", errors="ignore"))[3:] == ["ABC1 1AA", "123", None]
    with pytest.raises(Exception, match="postcode"):
        values(spark, raw, "string", R.format_postcode("x"))
    assert values(spark, ["W1A 0AX", "12 345", "SW1A 1A", None], "string", R.valid_postcode("x")) == [True, False, False, False]


def test_year_groups(spark):
    raw = ["y11", "Rec", "Year 07", "-1", "Y10/11", " YEAR R ", "FE Level 3", "Unknown", "2025", "99999999999", None]
    want = ["Year 11", "Reception", "Year 7", "Year 1", "Year 10", "Reception"] + [None] * 5
    assert values(spark, raw, "string", R.clean_year_group("x", errors="coerce")) == want
    assert values(spark, [-1, 0, 13, 14], "int", R.clean_year_group("x", errors="coerce")) == [None, "Reception", "Year 13", None]
    assert values(spark, [7.0, 7.5, float("nan")], "double", R.clean_year_group("x", errors="coerce")) == ["Year 7", None, None]
    assert values(spark, [True], "boolean", R.clean_year_group("x", errors="coerce")) == [None]
    for bad, told in (("FE Level 3", "further-education"), ("Unknown", "not a year group")):
        with pytest.raises(Exception, match=told):
            values(spark, [bad], "string", R.clean_year_group("x"))


def test_dates(spark):
    d = dt.date
    assert values(spark, [d(2025, 1, 2), d(2025, 2, 25), None], "date", R.reverse_date("x")) == [d(2025, 2, 1), d(2025, 2, 25), None]
    t = dt.datetime
    assert values(spark, [t(2025, 1, 2, 3, 4, 5)], "timestamp", R.reverse_date("x", timestamp=True)) == [t(2025, 2, 1, 3, 4, 5)]
    born = [d(2020, 9, 1), d(2020, 1, 1), d(2024, 1, 1), d(2005, 10, 1), None]
    assert values(spark, born, "date", R.year_group_from_date("x", 2025, errors="ignore")) == ["Reception", "Year 1", "Student too young for school", None, None]
    with pytest.raises(Exception, match="not a school year"):
        values(spark, born, "date", R.year_group_from_date("x", 2025))
    ranges = values(spark, ["7", "15", "Year 1"], "string", R.dob_range("x", 2025, "coerce"))
    assert [tuple(r) for r in ranges] == [(d(2013, 9, 1), d(2014, 8, 31)), (None, None), (d(2019, 9, 1), d(2020, 8, 31))]
    with pytest.raises(TypeError):
        R.dob_range("x", "2025")


@pytest.mark.parametrize("day, year", [((2024, 9, 1), 2024), ((2025, 8, 31), 2024), ((2024, 2, 29), 2023), ((2024, 12, 31), 2024)])
def test_academic_year(day, year):
    assert R.academic_year_start(dt.date(*day)) == year


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_against_dynamic_programming(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    pairs = [(word(rng.randrange(12)), word(rng.randrange(12))) for _ in range(200)]
    pairs += [(word(rng.randrange(55, 140)), word(rng.randrange(55, 200))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = [tuple(r) for r in df.select(R.ratio("a", "b"), R.token_sort_ratio("a", "b")).collect()]
    ratio = lambda a, b: 100.0 if not a + b else 200 * lcs(a, b) / len(a + b)
    order = lambda t: " ".join(sorted(t.split()))
    for (a, b), (r, t) in zip(pairs, got):
        assert r == pytest.approx(ratio(a, b)) and t == pytest.approx(ratio(order(a), order(b)))


def test_printed_scores(spark):
    df = spark.createDataFrame([("Mike Jones", "Michael Jones"), ("Jane Doe", "Janie Doe"), ("Jane D.", "Jane Doe"), (None, "x")], "a string, b string")
    out = df.select(F.bround(R.token_sort_ratio("a", "b"), 2))
    assert [r[0] for r in out.collect()] == [78.26, 94.12, 80.0, None]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_stream_of_names(spark, tmp_path):
    spark.createDataFrame([("JANE  DOE",)], "x string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string").parquet(str(tmp_path / "in")).select(R.format_name("x").alias("x"))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Jane Doe"]
