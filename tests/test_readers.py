import pytest

from conftest import rows
from pairloom.config import PRESETS, MatchConfig, SourceFormat
from pairloom.sources.readers import read_headed, read_headerless, read_records, read_truth
from pairloom.sources.store import read_embedded, write_embedded, write_matches


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_headed_csv_by_name(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'price,id,name\n3,1,"x, ""y"""\n,2,\n')
    assert [tuple(r) for r in read_headed(spark, path, ["id", "name", "price"]).collect()] == [
        ("1", 'x, "y"', "3"), ("2", None, None)]
    with pytest.raises(ValueError):
        read_headed(spark, path, ["id", "nope"])


@pytest.mark.parametrize("separator", ["|", "\t", ","])
def test_separators(spark, tmp_path, separator):
    path = put(tmp_path, "s.txt", separator.join(["id", "title"]) + "\n" + separator.join(["1", "t"]) + "\n")
    assert rows(read_headed(spark, path, ["id", "title"], SourceFormat(separator=separator))) == [("1", "t")]


def test_headerless_pads_short_and_skips_long(spark, tmp_path):
    path = put(tmp_path, "h.txt", '1,a,b\n2,a\n3,a,b,c\n4,"x,y",b\n')
    got = read_headerless(spark, path, ["id", "p", "q"], SourceFormat(header=False, skip_long_lines=True))
    assert {tuple(r) for r in got.collect()} == {("1", "a", "b"), ("2", "a", None), ("4", "x,y", "b")}


def test_lines_with_an_empty_extra_cell_are_skipped(spark, tmp_path):
    path = put(tmp_path, "h.txt", '1,a,b\n2,a,b,\n3,a,\n4,"x,""y",b\n5,"x,",b,""\n\n6\n')
    got = read_headerless(spark, path, ["id", "p", "q"], SourceFormat(header=False, skip_long_lines=True))
    assert {tuple(r) for r in got.collect()} == {("1", "a", "b"), ("3", "a", None), ("4", 'x,"y', "b"), ("6", None, None)}


def messy(rng, n):
    """Rows with line breaks, quotes, separators and stray quotes inside their cells, and their text as a file."""
    out, lines = [], ["id,p,q"]
    for i in range(n):
        cells = [str(i)]
        for _ in range(2):
            cells.append("".join(rng.choice(["a", "b", ",", "\n", '"', "é", " ", "\n\n", "x,\n"]) for _ in range(rng.randint(1, 9))) + "z")
        out.append(tuple(cells))
        lines.append(",".join(c if c.isalnum() else '"' + c.replace('"', '""') + '"' for c in cells))
    return out, "\n".join(lines) + "\n"


def test_records_over_several_lines_at_any_split(spark, tmp_path):
    import random

    wanted, text = messy(random.Random(6), 300)
    path = put(tmp_path, "m.csv", text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for block in (size, "97", "401"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(map(tuple, read_headed(spark, path, ["id", "p", "q"]).collect())) == sorted(wanted)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'id,name\r\n1,5" pipe\r\n2,"a\nb"\r\n3,say "x"\r\n')
    assert rows(read_headed(spark, path, ["id", "name"])) == [("1", '5" pipe'), ("2", "a\nb"), ("3", 'say "x"')]


def test_a_folder_of_files_keeps_each_header_out_and_orders_by_name(spark, tmp_path):
    for name, body in (("2.csv", "5,x\n5,y\n"), ("1.csv", "5,z\n")):
        put(tmp_path, name, "idAbt,idBuy\n" + body)
    got = read_truth(spark, str(tmp_path), PRESETS["abt"]).orderBy("row_order")
    assert [(r.a_id, r.b_id) for r in got.collect()] == [("5", "z"), ("5", "x"), ("5", "y")]
    put(tmp_path, "3.csv", "idAbt,other\n")
    with pytest.raises(ValueError):
        read_truth(spark, str(tmp_path), PRESETS["abt"])


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pairloom.sources.readers.RECORD_LINES", 20)
    path = put(tmp_path, "u.csv", 'id,name\n1,"a\n' + "x\n" * 50)
    with pytest.raises(Exception, match="never closed"):
        read_headed(spark, path, ["id", "name"]).collect()


def test_presets_read_latin_files(spark, tmp_path):
    for name in ("abt", "acm", "amazon", "walmart", "restaurants", "scholar"):
        config = PRESETS[name]
        path = put(tmp_path, f"{name}.csv", ",".join(["id", *config.columns]) + "\n1" + ",café" * len(config.columns) + "\n", "latin-1")
        assert read_records(spark, path, config).first()[1] == "café"


def test_encoding(spark, tmp_path):
    path = put(tmp_path, "l.csv", "id,name\n1,café\n", "latin-1")
    assert rows(read_headed(spark, path, ["id", "name"], SourceFormat(encoding="ISO-8859-1"))) == [("1", "café")]


def test_truth_keeps_empty_cells_and_file_order(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "id1\tid2\tclass\n1\t9\tDPL\n1\t2\tDPL\n\t3\tDPL\n")
    got = read_truth(spark, path, PRESETS["walmart"]).orderBy("row_order")
    assert [(r.a_id, r.b_id) for r in got.collect()] == [("1", "9"), ("1", "2"), ("", "3")]


def test_records_follow_the_preset(spark, tmp_path):
    path = put(tmp_path, "v.txt", "1,s,n,ad,to,p\n")
    assert read_records(spark, path, PRESETS["voters"]).columns == ["id", "surname", "name", "address", "town", "ps"]


def test_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", [0.25, 0.5])], "id string, v array<double>")
    write_embedded(df, str(tmp_path / "e"))
    assert read_embedded(spark, str(tmp_path / "e")).first()["v"] == [0.25, 0.5]
    matches = spark.createDataFrame([("1", "2", 0.5, 0.6, 1.0)], "a_id string, b_id string, p1 double, p2 double, label double")
    write_matches(matches, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_presets_are_complete():
    assert sorted(PRESETS) == ["abt", "acm", "amazon", "dblp", "imdb", "restaurants", "scholar", "voters", "walmart"]
    assert {n for n, c in PRESETS.items() if c.truth_mode == "last"} == {"restaurants", "voters", "dblp"}
    assert {n for n, c in PRESETS.items() if c.index_side == "b"} == {"acm", "walmart", "restaurants"}
    assert PRESETS["imdb"].sampled_side == "a" and PRESETS["abt"].sampled_side == "b"


def test_config_rejects_unknown_name_column():
    with pytest.raises(ValueError):
        MatchConfig(name="x", columns=("surname",), name_column="title")
