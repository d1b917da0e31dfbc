"""Selection, splits, sampling, encoding, datasets and sources."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.core import AnnotatedMatrix
from cellframe.operators import encoding, preprocess
from cellframe.plans import datasets
from cellframe.sources import tables
from cellframe.streaming.datasets import HeldDataset, StreamedDataset, encode_stream


def strata(spark, sizes):
    rows = [(k, s) for k, s in enumerate(s for name, n in sizes.items() for s in [name] * n)]
    return spark.createDataFrame(rows, "cell_id long, cell_type string")


@pytest.fixture(scope="module")
def small(spark):
    cells = spark.createDataFrame(
        [(i, i, "TB"[i % 2], f"b{i % 3}", float(i * 10)) for i in range(20)], "cell_id long, cell_pos long, cell_type string, batch string, total double"
    )
    genes = spark.createDataFrame([(j, f"G{j}", j, j < 3) for j in range(5)], "gene_id long, gene_name string, gene_pos long, hv boolean")
    counts = spark.createDataFrame([(i, j, float(i + j)) for i in range(1, 20) for j in range(5) if (i + j) % 2], "cell_id long, gene_id long, value double")
    return AnnotatedMatrix(cells, genes, counts)


def test_split_covers_all_cells_in_proportion(spark):
    cells = strata(spark, {"a": 700, "b": 250, "c": 49, "d": 1})
    got = preprocess.stratified_split(cells, "cell_type", 0.1, 0.1).join(cells, "cell_id").collect()
    n = Counter(r.split for r in got)
    assert len(got) == 1000 and n["val"] == pytest.approx(100, abs=2) and n["test"] == pytest.approx(100, abs=2)
    assert [r.split for r in got if r.cell_type == "d"] == ["train"]
    again = preprocess.stratified_split(cells, "cell_type", 0.1, 0.1)
    assert sorted((r.cell_id, r.split) for r in again.collect()) == sorted((r.cell_id, r.split) for r in got)
    other = preprocess.stratified_split(cells, "cell_type", 0.1, 0.1, seed=1)
    assert sorted((r.cell_id, r.split) for r in other.collect()) != sorted((r.cell_id, r.split) for r in got)


@pytest.mark.parametrize(("val", "test", "splits"), [(0, 0, {"train"}), (0.2, 0, {"train", "val"}), (0, 0.2, {"train", "test"})])
def test_split_without_a_part(spark, val, test, splits):
    got = preprocess.stratified_split(strata(spark, {"a": 50, "b": 50}), "cell_type", val, test).collect()
    assert {r.split for r in got} == splits and len(got) == 100


@pytest.mark.parametrize("ratios", [(-0.1, 0.1), (0.5, 0.5)])
def test_bad_ratios_raise(spark, ratios):
    with pytest.raises(ValueError):
        preprocess.stratified_split(strata(spark, {"a": 5}), "cell_type", *ratios)


def test_sample_keeps_rare_strata_and_meets_its_size(spark):
    cells = strata(spark, {"Rare": 5, "Big": 500, "Other": 300})
    got = preprocess.hvg_sample(cells, "cell_type", target_size=100, min_cells=10).join(cells, "cell_id").collect()
    assert Counter(r.cell_type for r in got) == {"Rare": 5, "Big": 59, "Other": 36}
    assert preprocess.hvg_sample(cells, "cell_type", target_size=805) is None
    only = preprocess.hvg_sample(strata(spark, {"a": 80, "b": 90, "c": 400}), "cell_type", target_size=100).count()
    assert only == 170
    assert preprocess.subsample(cells, 50).count() == 50 and preprocess.subsample(cells, 1000) is None


def test_null_strata_are_a_stratum(spark):
    cells = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "cell_id long, cell_type string")
    assert preprocess.stratified_split(cells, "cell_type", 0.1, 0.1).count() == 40


def test_names_become_unique(spark):
    genes = spark.createDataFrame([(i, n) for i, n in enumerate("XXYX")], "gene_pos long, gene_name string")
    assert [r.gene_name for r in preprocess.unique_names(genes).orderBy("gene_pos").collect()] == ["X", "X-1", "Y", "X-2"]


def test_gene_filters(spark):
    genes = spark.createDataFrame([("MT-CO1", True), ("LINC1", True), ("CD3E", True), ("LOC9", False)], "gene_name string, highly_variable boolean")
    masked = {r.gene_name: r.highly_variable for r in preprocess.filter_genes(genes).collect()}
    assert masked == {"MT-CO1": True, "LINC1": False, "CD3E": True, "LOC9": False}
    assert preprocess.filter_genes(genes, mask_hvg_only=False, mito_encoded=True).count() == 1
    off = {k.lower(): False for k in preprocess.HUMAN}
    assert preprocess.filter_genes(genes.drop("highly_variable"), **off).count() == 4
    with pytest.raises(ValueError):
        preprocess.filter_genes(genes.drop("highly_variable"))
    with pytest.raises(ValueError):
        preprocess.active_pattern("human", unknown=True)


def test_resolving_genes(small):
    got = preprocess.resolve_genes(small.genes, ["G4", "G1"]).orderBy("column").collect()
    assert [(r.gene_name, r["column"]) for r in got] == [("G1", 0), ("G4", 1)]
    assert preprocess.resolve_genes(small.genes, gene_col="hv").count() == 3
    with pytest.raises(ValueError, match="nope"):
        preprocess.resolve_genes(small.genes, ["nope"])
    with pytest.raises(ValueError):
        preprocess.resolve_genes(small.genes, ["G1"], "hv")


def test_zero_rows_stay_zero(spark, small):
    values = preprocess.normalize(small)
    assert values.where("cell_id = 0").isEmpty()
    sums = values.groupBy("cell_id").agg(F.sum(F.expm1("value")).alias("s")).collect()
    assert all(r.s == pytest.approx(1e4) for r in sums)


def test_values_are_checked(spark, small):
    assert preprocess.validate_values(small.counts, "counts").first().ok
    assert preprocess.validate_values(preprocess.normalize(small), "normalized").first().ok
    assert preprocess.validate_values(small.counts.where("false"), "counts").first().ok
    with pytest.raises(ValueError):
        preprocess.validate_values(preprocess.normalize(small), "counts", strict=True)


def test_specifications():
    assert encoding.parse_numerical("a:log1p:zscore") == encoding.NumericalSpec("a", ("log1p", "zscore"))
    two = encoding.parse_categorical("b:groupmean(x:log1p, y)")
    assert [(s.value_col, s.value_transforms) for s in two] == [("x", ("log1p",)), ("y", ())]
    for bad in ("a:sqrt", "a:zscore:log1p"):
        with pytest.raises(ValueError):
            encoding.parse_numerical(bad)
    for bad in ("b", "b:other"):
        with pytest.raises(ValueError):
            encoding.parse_categorical(bad)


def test_vectors_and_unknown_categories(spark, small, tmp_path):
    schema = encoding.build_schema(small.cells, [encoding.parse_numerical("total:zscore")], encoding.parse_categorical("batch:onehot"), batch_key="batch")
    assert schema.n_cond == 4
    rows = small.cells.select("cell_id", encoding.condition_vector(schema).alias("v")).orderBy("cell_id").collect()
    assert [list(r.v[1:]) for r in rows[:3]] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert sum(r.v[0] for r in rows) == pytest.approx(0, abs=1e-4)
    schema.save(tmp_path / "s.json")
    assert encoding.ConditionSchema.load(tmp_path / "s.json") == schema
    (tmp_path / "bad.json").write_text(json.dumps({"n_cond": 1}))
    with pytest.raises(ValueError):
        encoding.ConditionSchema.load(tmp_path / "bad.json")
    with pytest.raises(ValueError, match="b9"):
        encoding.check_categories(small.cells.withColumn("batch", F.lit("b9")), schema)
    with pytest.raises(ValueError):
        encoding.build_schema(small.cells.withColumn("c", F.lit(1.0)), [encoding.parse_numerical("c:zscore")], [])
    assert encoding.condition_vector(encoding.ConditionSchema((), 0)) is not None


def test_a_matrix_comes_back_from_its_folder(spark, small, tmp_path):
    vec = small.cells.select("cell_id", F.array(F.col("total")).alias("vec"), F.lit("X_umap").alias("key"))
    tables.write_matrix(str(tmp_path), small, {"raw.X": small.counts.withColumn("value", F.col("value") * 2)}, vec)
    back = tables.read_matrix(spark, str(tmp_path), "raw.X")
    assert back.counts.agg(F.sum("value")).first()[0] == 2 * small.counts.agg(F.sum("value")).first()[0]
    assert tables.read_embedding(spark, str(tmp_path), "X_umap").count() == 20
    with pytest.raises(ValueError):
        tables.read_counts(spark, str(tmp_path), "layers/none")
    with pytest.raises(KeyError):
        tables.read_embedding(spark, str(tmp_path), "none")
    got = tables.take_rows(small, [5, 2, 5]).groupBy("row").agg(F.first("cell_id").alias("c")).orderBy("row").collect()
    assert [r.c for r in got] == [5, 2, 5]
    assert {r.cell_id for r in tables.row_range(small, 3, 6).collect()} == {3, 4, 5}


def test_latents_and_gene_lists(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5])], "cell_id long, vec array<double>")
    with pytest.raises(FileNotFoundError):
        tables.load_latent(spark, str(tmp_path))
    for s in ("train", "val"):
        v.write.parquet(f"{tmp_path}/{s}_latent")
    assert tables.load_latent(spark, str(tmp_path)).count() == 2
    np.save(tmp_path / "train_qz_mean.npy", np.arange(6.0).reshape(3, 2))
    np.save(tmp_path / "val_qz_mean.npy", np.array([[9.0, 8.0]], np.float32))
    got = tables.load_latent(spark, str(tmp_path)).orderBy("cell_id").collect()
    assert [(r.cell_id, list(r.vec)) for r in got] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5]), (3, [9, 8])]
    v.write.parquet(f"{tmp_path}/eval/qz_mean")
    assert tables.load_latent(spark, str(tmp_path)).count() == 1
    (tmp_path / "g.txt").write_text(" A \n\nB\n")
    (tmp_path / "g.json").write_text('{"hvg_genes": ["C"]}')
    assert tables.load_gene_list(tmp_path / "g.txt") == ["A", "B"] and tables.load_gene_list(tmp_path / "g.json") == ["C"]
    codes = spark.createDataFrame([(0, "x"), (1, "y")], "code int, label string")
    cells = spark.createDataFrame([(1, 1), (2, 7)], "cell_id long, kind int")
    assert [r.kind for r in tables.decode_categories(cells, "kind", codes).orderBy("cell_id").collect()] == ["y", None]


@pytest.mark.parametrize("form", ["split", "chunks"])
def test_a_dataset_is_built_and_read(spark, small, tmp_path, form):
    tables.write_matrix(f"{tmp_path}/in", small)
    done = datasets.build_dataset(
        spark, f"{tmp_path}/in", f"{tmp_path}/out", gene_col="hv", label="cell_type", numerical=["total"], categorical=["batch:onehot"], chunk_size=8, output_format=form
    )
    meta = datasets.load_metadata(spark, f"{tmp_path}/out")
    assert done and meta["gene_names"] == ["G0", "G1", "G2"] and meta["labels"] == {"B": 0, "T": 1} and meta["n_cond"] == 4
    assert form == "split" or meta["chunk_sizes"] == [8, 8, 4]
    held = StreamedDataset(spark, f"{tmp_path}/out")
    first = [r.cell_id for r in held]
    held.set_epoch(1)
    assert sorted(first) == list(range(20)) and [r.cell_id for r in held] != first and len(held) == 20
    row = next(r for r in held if r.cell_id == 4)
    assert (list(row.counts), list(row.condition), row.label) == ([0.0, 5.0, 0.0], [40.0, 0.0, 1.0, 0.0], 1)
    assert not datasets.build_dataset(spark, f"{tmp_path}/none", f"{tmp_path}/out")
    if form == "split":
        data = HeldDataset(spark, f"{tmp_path}/out", dtype="double")
        assert [r.cell_pos for r in data.__getitems__([2, 0, 2])] == [2, 0, 2] and data[0].cell_pos == 0
        with pytest.raises(IndexError):
            data.__getitems__([0, 10**9])
        assert len(data) == 20 and data[4].cell_id == 4
        with pytest.raises(IndexError):
            data[99]


def test_standardized_tables_by_split(spark, small, tmp_path):
    splits = small.cells.select("cell_id", F.when(F.col("cell_id") < 16, "train").otherwise("val").alias("split"))
    stats = datasets.build_standardized(small, splits, str(tmp_path), "cell_type", "batch", "demo", small.genes.where("hv"), extra={"total": "price", "no": "x"})
    got = {r.split: r for r in stats.collect()}
    assert (got["train"].n_cells, got["val"].n_cells, got["test"].n_cells, got["test"].library_size_mean) == (16, 4, 0, 0)
    cells = spark.read.parquet(f"{tmp_path}/cells").where("split = 'val'")
    assert set(cells.columns) == {"cell_id", "cell_type", "batch", "tissue", "dataset", "library_size", "price", "split"}
    assert {r.tissue for r in cells.collect()} == {"demo"}
    assert spark.read.parquet(f"{tmp_path}/genes").where("highly_variable").count() == 3


def test_encoding_runs_on_a_stream(spark, small, tmp_path):
    small.cells.write.parquet(f"{tmp_path}/cells")
    schema = encoding.build_schema(small.cells, [], encoding.parse_categorical("batch:onehot"))
    stream = spark.readStream.schema(small.cells.schema).parquet(f"{tmp_path}/cells")
    q = encode_stream(stream, schema).writeStream.format("memory").queryName("encoded").start()
    try:
        q.processAllAvailable()
        assert spark.table("encoded").count() == 20
    finally:
        q.stop()


def test_order_statistics_are_exact(spark):
    from cellframe.core import order_statistics, percentiles

    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.normal(size=500)] + [("b", float(v)) for v in rng.integers(0, 4, 300)] + [("c", 1.5), (None, 2.0), (None, 3.0), ("a", None), ("d", None)]
    table = spark.createDataFrame(rows, "k string, v double")
    groups = {k: sorted(v for g, v in rows if g == k and v is not None) for k in ("a", "b", "c", None)}
    got = {r.k: r for r in order_statistics(table, ["k"], "v", {"low": (F.floor(F.col("n") * 0.1) + 1, 0.1), "top": (F.col("n"), 0.2)}).collect()}
    assert {k: (r.n, r.low, r.top) for k, r in got.items()} == {k: (len(v), v[int(len(v) * 0.1)], v[-1]) for k, v in groups.items()}
    for r in percentiles(table, ["k"], "v", {"q": 0.25, "m": 0.5}).collect():
        assert (r.q, r.m) == pytest.approx(tuple(np.quantile(groups[r.k], [0.25, 0.5])))
    assert percentiles(table.where("false"), [], "v", {"q": 0.5}).count() == 0


def test_whole_counts_keep_to_their_type(spark, small):
    from cellframe.plans.datasets import dataset_rows

    genes = preprocess.resolve_genes(small.genes)
    got = dataset_rows(small, genes, dtype="short")
    assert dict(got.dtypes)["counts"] == "array<smallint>" and got.count() == small.cells.count()
    with pytest.raises(ValueError):
        dataset_rows(AnnotatedMatrix(small.cells, small.genes, small.counts.withColumn("value", F.col("value") + 40_000)), genes, dtype="short")
    first = preprocess.validate_values(small.counts, "counts", sample_n=3).first()
    assert first.ok and first.fraction_integer == 1.0
