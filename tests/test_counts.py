"""Count matrices as coordinate text, and instrument folders with them."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sliceweave.operators.matrix import Matrix
from sliceweave.sources import bundles
from sliceweave.sources import coordinate_text as CT

HEAD = "%%MatrixMarket matrix coordinate integer general\n%metadata_json: {}\n% 9 9 9\n"


def folder(path, matrix, barcodes, features, zipped=False):
    path.mkdir(parents=True)
    for name, text in ((CT.MATRIX, matrix), (CT.COLUMNS, barcodes), (CT.ROWS, features)):
        if zipped:
            (path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (path / name).write_text(text)
    return str(path)


def dense(m):
    return Counter({(r["barcode"], r["feature_id"]): r["value"] for r in m.x.groupBy("obs_pos", "var_pos").agg(F.sum("value").alias("value")).join(m.obs, "obs_pos").join(m.var, "var_pos").collect()})


@pytest.mark.parametrize("zipped", [False, True])
def test_reads_a_folder(spark, tmp_path, zipped):
    path = folder(tmp_path / "m", HEAD + "3 2 4\n1 1 5\n3 2 7\n3 1 1\n2 2 10\n", "AA-1\nBB-1\n", "g1\tGene 1\tGene Expression\ng2\tGene2\tGene Expression\ng3\tÄ\tAntibody\n", zipped)
    m = CT.read_counts(spark, path)
    assert dense(m) == {("AA-1", "g1"): 5, ("BB-1", "g3"): 7, ("AA-1", "g3"): 1, ("BB-1", "g2"): 10}
    assert [(r["obs_pos"], r["barcode"]) for r in m.obs.orderBy("obs_pos").collect()] == [(0, "AA-1"), (1, "BB-1")]
    assert m.var.filter("symbol = 'Ä'").first()["feature_type"] == "Antibody"


def test_many_splits_keep_the_file_order(spark, tmp_path):
    """Splits of a few lines each: the size line is told from entries like it, and names are numbered as in their file."""
    rng = random.Random(3)
    names = [f"b{rng.randrange(10 ** 9)}-{i}" for i in range(700)]
    genes = [f"g{rng.randrange(10 ** 9)}-{i}\tn{i}\tx" for i in range(300)]
    cells = Counter()
    for _ in range(2500):
        cells[rng.randrange(300), rng.randrange(700)] += rng.randrange(1, 9)
    cells[299, 699] = len(cells | Counter({(299, 699): 1}))  # the line of this entry is the size line
    lines = [f"{g + 1} {b + 1} {v}" for (g, b), v in cells.items()]
    rng.shuffle(lines)
    path = folder(tmp_path / "m", HEAD + f"300 700 {len(lines)}\n" + "\n".join(lines) + "\n\n", "\n".join(names) + "\n", "\r\n".join(genes))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        m = CT.read_counts(spark, path)
        assert m.x.count() == len(lines)
        got = dense(m)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(names[b], genes[g].split("\t")[0]): v for (g, b), v in cells.items()}


def test_kinds_of_numbers_and_faults(spark, tmp_path):
    real = HEAD.replace("integer", "real")
    assert dense(CT.read_counts(spark, folder(tmp_path / "a", real + "1 1 1\n1 1 2.5e-1\n", "b\n", "g\tg\tx\n"))) == {("b", "g"): 0.25}
    pattern = HEAD.replace("integer", "Pattern")
    assert dense(CT.read_counts(spark, folder(tmp_path / "b", pattern + "1 2 1\n1 2\n", "b\nc\n", "g\n"))) == {("c", "g"): 1}
    empty = CT.read_counts(spark, folder(tmp_path / "c", HEAD + "1 2 0\n", "b\nc\n", "g\n"))
    assert empty.x.count() == 0 and empty.obs.count() == 2 and empty.var.first()["symbol"] is None
    for i, (text, said) in enumerate([
            ("1 1 1\n1 1 1\n", "not a general"), (HEAD.replace("general", "symmetric") + "1 1 1\n1 1 1\n", "not a general"), (HEAD, "no size line"), (HEAD + "1 1\n", "no size line"),
            (HEAD + "1 1 1\n1 1\n", "torn"), (HEAD + "1 1 1\n2 1 1\n", "outside"), (HEAD + "1 1 1\n0 1 1\n", "outside"), (HEAD + "1 1 1\n1 1 x\n", "torn"),
            (HEAD + "1 1 2\n1 1 1\n", "announces 2"), (HEAD + "1 2 1\n1 1 1\n", "1 barcodes for 2")]):
        with pytest.raises(ValueError, match=said):
            CT.read_counts(spark, folder(tmp_path / f"f{i}", text, "b\n", "g\n"))
    with pytest.raises(FileNotFoundError):
        CT.read_counts(spark, str(tmp_path / "none"))


def test_write_and_read_again(spark, tmp_path):
    x = spark.createDataFrame([(f"o{i % 40:02}", f"v{i * i % 23:02}", float(i % 5) / (2 if i % 2 else 1)) for i in range(400)], "o string, v string, value double").repartition(5)
    obs = x.select("o").distinct().withColumn("code", F.concat(F.lit("code "), "o"))
    var = x.select("v").distinct().withColumn("sym", F.upper("v"))
    for i, m in enumerate([Matrix(obs, var, x, "o", "v"), Matrix(obs, var, x.withColumn("value", F.floor("value")), "o", "v")]):
        CT.write_counts(m, str(tmp_path / f"w{i}"), "code", ["v", "sym"], "gzip")
        got = CT.read_counts(spark, str(tmp_path / f"w{i}"))
        want = Counter({(f"code {r['o']}", r["v"]): r["s"] for r in m.x.groupBy("o", "v").agg(F.sum("value").alias("s")).collect()})
        assert dense(got) == want and got.x.count() == 400
        assert [r["barcode"] for r in got.obs.orderBy("obs_pos").collect()] == sorted(r["code"] for r in obs.collect())
        banner = spark.read.text(str(tmp_path / f"w{i}" / CT.MATRIX)).filter("value like '%MatrixMarket%'").first()[0]
        assert ("integer" in banner) == bool(i)


def test_instrument_folders_have_counts(spark, tmp_path):
    pos = spark.createDataFrame([(f"b{i}", 1, i, i, 1.0 * i, 2.0 * i) for i in range(4)],
                                "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double")
    at = tmp_path / "v/binned_outputs/square_002um"
    pos.write.parquet(str(at / "spatial/tissue_positions.parquet"))
    folder(at / "raw_feature_bc_matrix", HEAD + "2 4 3\n1 4 1\n2 1 3\n2 2 1\n", "b3\nb2\nb1\nb0\n", "g1\ng2\n")
    folder(at / "filtered_feature_bc_matrix", HEAD + "2 1 1\n2 1 3\n", "b3\n", "g1\ng2\n", True)
    kept = bundles.counts_of(bundles.read_visium_hd(spark, str(tmp_path / "v"), spacing=1.0), "square_002um")
    assert dense(kept) == {("b3", "g2"): 3} and kept.obs.first()["x"] == 6.0
    raw = bundles.counts_of(bundles.read_visium_hd(spark, str(tmp_path / "v"), spacing=1.0, raw_counts=True), "square_002um")
    assert dense(raw) == {("b0", "g1"): 1, ("b3", "g2"): 3, ("b2", "g2"): 1}
    none = bundles.read_visium_hd(spark, str(tmp_path / "v"), spacing=1.0, counts=False)
    assert not any(k.startswith("counts/") for k in none)
    spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "cell_id string, cell_area double").write.parquet(str(tmp_path / "x/cells.parquet"))
    flags = dict(cells_boundaries=False, nucleus_boundaries=False, transcripts=False)
    assert not any(k.startswith("counts/") for k in bundles.read_xenium(spark, str(tmp_path / "x"), **flags))
    with pytest.raises(FileNotFoundError):
        bundles.read_xenium(spark, str(tmp_path / "x"), counts=True, **flags)
    folder(tmp_path / "x/cell_feature_matrix", HEAD + "1 2 1\n1 2 4\n", "c2\nc1\n", "g1\tG\tGene Expression\n", True)
    cells = bundles.counts_of(bundles.read_xenium(spark, str(tmp_path / "x"), **flags), "table")
    assert dense(cells) == {("c1", "g1"): 4} and {r["barcode"]: r["cell_area"] for r in cells.obs.collect()} == {"c1": 1.0, "c2": 2.0}
