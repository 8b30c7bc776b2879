import random

import pytest

from ratewise.sources import quotedcsv as Q


def one_task(spark, path):
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def texts(seed, n, long=0):
    rng = random.Random(seed)
    parts = ["a", "word", ",", '"', "\n", "\n\n", '",\n"', " x ", '""', "é", ",,", "\n\"\n"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + ["line\n" * long + '"end"'] * bool(long)


def file_of(path, values, end="\n", close=True, plain=True):
    lines = ["id,text,more"]
    for i, t in enumerate(values):
        lines.append(f"{i},{quoted(t)}," + ('5" pipe' if plain and i % 3 == 0 else quoted("m,m") if i % 3 == 1 else ""))
    body = "\n".join(lines) + ("\n" if close else "")
    path.write_text(body.replace("\n", end), newline="", encoding="utf-8")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_reader_of_one_task(spark, tmp_path, small_splits, seed):
    """Breaks, doubled quotes, quotes inside plain fields, a record over many splits, no last line break."""
    path = tmp_path / "t.csv"
    file_of(path, texts(seed, 60, long=200), close=seed != 2)
    got = Q.read_quoted_csv(spark, str(path))
    assert got.columns == ["id", "text", "more"]
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
    assert rows(got) == rows(one_task(spark, str(path)))


def test_several_files_and_carriage_returns(spark, tmp_path, small_splits):
    folder = tmp_path / "f"
    folder.mkdir()
    values = [t.replace("\r", "") for t in texts(5, 30)]
    file_of(folder / "a.csv", values)
    file_of(folder / "b.csv", ["one\ntwo", 'x"y'])
    assert rows(Q.read_quoted_csv(spark, str(folder))) == rows(one_task(spark, str(folder)))
    file_of(tmp_path / "crlf.csv", values, end="\r\n")
    assert rows(Q.read_quoted_csv(spark, str(tmp_path / "crlf.csv"))) == rows(one_task(spark, str(tmp_path / "crlf.csv")))


def test_short_wide_and_unclosed_records(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1\n\n2,x,y\n"q\nr",""\n' + "3,z\n" * 80 + '4,"never\nclosed\n' + "5,w\n" * 60)
    got = Q.read_quoted_csv(spark, str(path)).collect()
    values = sorted((r["a"], r["b"]) for r in got if r["a"] != "4" and r["b"] is not None)
    assert values == sorted([("2", "x")] + [("3", "z")] * 80)
    last = [r["b"] for r in got if r["a"] == "4"]
    assert len(last) == 1 and "never\nclosed" in last[0] and last[0].count("5,w") == 60
    # an empty text is null, quoted or not, as for Spark's reader
    assert {(r["a"], r["b"]) for r in got if r["b"] is None} == {("1", None), ("q\nr", None)}


def test_header_only(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    got = Q.read_quoted_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["a", "b"] and got.count() == 0
