"""Normalization, checks, gene selection, splits, sampling, variable genes."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix, largest_remainder, no_column, ranked_by_hash, ratio
from .dense import dense_rows
from .pearson import library_depth

# Nomenclature patterns of uninformative genes, by species.
HUMAN = {
    "Predicted": r"^(AC|AL|AP|AJ|AF|CT|FP|GS|KB|LR)\d+(\.\d+)?$|^LOC\d+",
    "Non_Coding": r"^LINC|^MIR|^SNOR",
    "Antisense": r"-AS\d*$",
    "IG_Var": r"^IGKV|^IGLV|^IGHV|^IGKC$|^IGLC[1-7]$|^IGH[GADM][1-4]?$",
    "Hemoglobin": r"^HB[ABDGEMQZ]",
    "Metallothionein": r"^MT[12]",
    "Histone": r"^(HIST1H|HIST2H|HIST3H|HIST4H)",
    "Mito_Encoded": r"^MT-",
    "Ribosomal": r"^RP[SL]\d+|^RPLP[012]|^RPSA$",
}
MOUSE = {
    "Predicted": r"^(Ac|Al|Ap|Aj|Af|Ct|Fp|Gs|Kb|Lr)\d+(\.\d+)?$|^Gm\d+|^LOC\d+",
    "Non_Coding": r"^Linc|^Mir|^Snor",
    "Antisense": r"-as\d*$",
    "IG_Var": r"^Igkv|^Iglv|^Ighv|^Igkc$|^Iglc[1-7]$|^Igh[gadm][1-4]?$",
    "Hemoglobin": r"^Hb[abdegemqz]",
    "Metallothionein": r"^Mt[12]",
    "Histone": r"^(Hist1h|Hist2h|Hist3h|Hist4h)",
    "Mito_Encoded": r"^mt-",
    "Ribosomal": r"^Rp[sl]\d+|^Rplp[012]|^Rpsa$",
}
RAT = MOUSE | {
    "Predicted": r"^(Ac|Al|Ap|Aj|Af|Ct|Fp|Gs|Kb|Lr)\d+(\.\d+)?$|^LOC\d+|^RGD\d+",
    "Mito_Encoded": r"^Mt-",
}
SPECIES = {"human": HUMAN, "mouse": MOUSE, "rat": RAT}
OFF_BY_DEFAULT = ("Histone", "Mito_Encoded", "Ribosomal")
# Background categories of human genes.
BACKGROUND = {
    "Mito_Encoded": r"^MT-",
    "Ribosomal": r"^RP[SL]\d+|^RPLP[012]|^RPSA$",
    "Hemoglobin": r"^HB[ABDGEMQZ]",
    "Metallothionein": r"^MT[12]",
    "HSP": r"^(HSP[A-Z0-9]|DNAJ[A-Z0-9]|HSPA|HSPB|HSPC|HSPH)",
    "IEG": r"^(FOS|FOSB|JUN|JUNB|JUND|ATF3|EGR1|EGR2|EGR3|IER2|IER3|DUSP1|DUSP2|NR4A1|NR4A2|NR4A3|BTG1|BTG2|KLF2|KLF4)$",
    "Cell_Cycle": r"^(MKI67|TOP2A|HMGB2|TUBA1B|TUBB|CENP|KIF|CCNA|CCNB|CDC|CDK1|UBE2C|BIRC5|PCNA|TYMS|MCM[2-7]|RRM[12]|STMN1)$",
    "Histone": r"^(HIST1H|HIST2H|HIST3H|HIST4H)",
    "Genomic_Clone": r"^(AC|AL|AP|AJ|AF|CT|FP|GS|KB|LR)\d+(\.\d+)?$",
    "Predicted_LOC": r"^LOC\d+",
    "Non_Coding": r"^LINC|^MIR|^SNOR|^SNOU|^GAS5$|-AS\d*$",
    "MALAT1": r"^MALAT1$",
    "Sex_Linked": r"^XIST$|^TSIX$|^RPS4Y1$|^EIF1AY$|^USP9Y$|^DDX3Y$|^UTY$|^NLGN4Y$|^KDM5D$",
    "Immune_Variable": r"^IGKV|^IGLV|^IGHV|^IGKC$|^IGLC[1-7]$|^IGH[GADM][1-4]?$|^TR[ABGV][V]$",
    "HKG_Classic": r"^GAPDH$|^ACTB$|^B2M$|^EEF1A1$|^TPT1$|^LDHA$|^NONO$|^PPIA$|^UBA52$",
}


def active_pattern(species: str = "human", **remove: bool) -> str:
    """The alternation of a species' switched-on patterns; empty if there are none.

    ``remove`` sets categories (``histone=True``); the last three are off by default.
    """
    names = {k.lower(): k for k in SPECIES[species]}
    unknown = set(remove) - set(names)
    if unknown:
        raise ValueError(f"unknown categories {sorted(unknown)}")
    on = [k for low, k in names.items() if remove.get(low, k not in OFF_BY_DEFAULT)]
    return "|".join(SPECIES[species][k] for k in on)


def filter_genes(genes: DataFrame, species: str = "human", mask_hvg_only: bool = True, **remove: bool) -> DataFrame:
    """Uninformative genes lose ``highly_variable``, or go with ``mask_hvg_only=False``."""
    pattern = active_pattern(species, **remove)
    if not pattern:
        return genes
    hit = F.coalesce(F.col("gene_name").rlike(pattern), F.lit(False))
    if not mask_hvg_only:
        return genes.where(~hit)
    if "highly_variable" not in genes.columns:
        raise ValueError("genes have no 'highly_variable' to mask; mark variable genes first, or use mask_hvg_only=False")
    return genes.withColumn("highly_variable", F.col("highly_variable") & ~hit)


def keep_genes(m: AnnotatedMatrix, genes: DataFrame) -> AnnotatedMatrix:
    """The matrix over ``genes`` alone."""
    return AnnotatedMatrix(m.cells, genes, m.counts.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi"))


def background_genes(genes: DataFrame) -> DataFrame:
    """(category, genes): ascending lists of matching names; a gene may be in several, none are empty."""
    found = F.array_compact(
        F.array(*[F.when(F.col("gene_name").rlike(p), F.lit(c)) for c, p in BACKGROUND.items()])
    )
    return genes.select("gene_name", F.explode(found).alias("category")).groupBy("category").agg(
        F.sort_array(F.collect_list("gene_name")).alias("genes")
    )


def resolve_genes(genes: DataFrame, gene_list: list[str] | None = None, gene_col: str | None = None) -> DataFrame:
    """Chosen genes in the order of ``gene_pos``, with their new ``column`` from 0."""
    if gene_list is not None and gene_col is not None:
        raise ValueError("give a gene list or a gene column, not both")
    chosen = genes
    if gene_list is not None:
        names = genes.sparkSession.createDataFrame([(g,) for g in dict.fromkeys(gene_list)], "gene_name string")
        missing = [r.gene_name for r in names.join(genes.select("gene_name"), "gene_name", "left_anti").limit(5).collect()]
        if missing:
            raise ValueError(f"genes not found, among them {sorted(missing)}")
        chosen = genes.join(F.broadcast(names), "gene_name", "left_semi")
    elif gene_col is not None:
        if gene_col not in genes.columns:
            raise no_column(gene_col, "genes", genes)
        chosen = genes.where(F.col(gene_col).cast("boolean"))
    return chosen.withColumn("column", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_pos")) - 1).cast("long"))


def unique_names(genes: DataFrame, name: str = "gene_name", pos: str = "gene_pos") -> DataFrame:
    """The second, third ... gene of a name gets ``-1``, ``-2`` ... behind it."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(pos)) - 1
    return genes.withColumn("_k", k).withColumn(
        name, F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("_k").cast("string")))
    ).drop("_k")


def build_genes(genes: DataFrame, variable: DataFrame | None, use_feature_name: bool = True) -> DataFrame:
    """``genes`` with ``highly_variable`` (is in ``variable``), named by ``feature_name`` if that is filled.

    More than half of the feature names have to be neither null nor blank.
    """
    out = genes
    if variable is not None:
        marked = variable.select("gene_id").distinct().withColumn("highly_variable", F.lit(True))
        out = out.drop("highly_variable").join(marked, "gene_id", "left").fillna(False, ["highly_variable"])
    if use_feature_name and "feature_name" in genes.columns:
        filled = F.coalesce(F.trim("feature_name") != "", F.lit(False)).cast("double")
        share = genes.agg(F.avg(filled).alias("s"))
        out = out.crossJoin(F.broadcast(share)).withColumn(
            "gene_name", F.when(F.col("s") > 0.5, F.col("feature_name")).otherwise(F.col("gene_name"))
        ).drop("s", "feature_name")
    return out


def standardize_cells(
    cells: DataFrame, library: DataFrame, cell_type: str, batch: str, dataset: str, extra: dict[str, str] | None = None
) -> DataFrame:
    """(cell_id, cell_type, batch, tissue, dataset, library_size, extras).

    ``tissue`` is the dataset's name where there is none; ``extra`` maps a source
    column to its name, sources that aren't there are passed over.
    """
    tissue = F.col("tissue") if "tissue" in cells.columns else F.lit(dataset)
    extras = [F.col(a).alias(b) for a, b in (extra or {}).items() if a in cells.columns]
    return cells.join(library, "cell_id").select(
        "cell_id", F.col(cell_type).alias("cell_type"), F.col(batch).alias("batch"), tissue.alias("tissue"),
        F.lit(dataset).alias("dataset"), F.col("depth").alias("library_size"), *extras,
    )


def normalize(m: AnnotatedMatrix, target_sum: float | None = 1e4) -> DataFrame:
    """(cell_id, gene_id, value): ``log1p(target * x / depth)`` of nonzero values; zeros stay absent.

    Without ``target_sum``, the median depth of cells with counts is taken.
    """
    depth = library_depth(m)
    if target_sum is None:
        depth = depth.crossJoin(F.broadcast(depth.where("depth > 0").agg(F.median("depth").alias("target"))))
    else:
        depth = depth.withColumn("target", F.lit(float(target_sum)))
    scale = F.col("target") / F.when(F.col("depth") == 0, 1.0).otherwise(F.col("depth"))
    return m.counts.join(depth, "cell_id").select(
        "cell_id", "gene_id", F.log1p(F.col("value").cast("double") * scale).alias("value")
    )


def validate_values(counts: DataFrame, expected: str, strict: bool = False, sample_n: int | None = None) -> DataFrame:
    """One row: ok, minimum, maximum, share of integers, over all values, or over the
    ``sample_n`` nonzero ones that come first by the hash of cell and gene.

    ``counts`` have to be whole and not negative, ``normalized`` values not all
    whole. An empty table is ok. ``strict`` raises where it isn't.
    """
    if expected not in ("counts", "normalized"):
        raise ValueError(f"unknown type of values {expected!r}")
    if sample_n is not None:
        counts = counts.where("value != 0").orderBy(F.xxhash64("cell_id", "gene_id"), "cell_id", "gene_id").limit(sample_n)
    x = F.col("value").cast("double")
    whole = F.abs(x - F.round(x)) < 1e-6
    row = counts.agg(
        F.count("*").alias("n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        F.avg(whole.cast("double")).alias("fraction_integer"), F.bool_and(whole).alias("all_whole"),
    )
    good = (F.col("all_whole") & (F.col("minimum") >= 0)) if expected == "counts" else ~F.col("all_whole")
    out = row.select(F.coalesce(good, F.lit(True)).alias("ok"), "minimum", "maximum", "fraction_integer")
    if strict:
        r = out.first()
        if not r.ok:
            raise ValueError(f"not {expected}: min {r.minimum}, max {r.maximum}, share of integers {r.fraction_integer}")
    return out


def matrix_shape(m: AnnotatedMatrix) -> DataFrame:
    """One row: n_obs, n_vars, nnz."""
    return m.cells.agg(F.count("*").alias("n_obs")).crossJoin(m.genes.agg(F.count("*").alias("n_vars"))).crossJoin(
        m.counts.agg(F.count(F.when(F.col("value") != 0, 1)).alias("nnz"))
    )


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def stratified_split(cells: DataFrame, by: str, val_ratio: float = 0.05, test_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """(cell_id, split): train, val or test, in the strata's proportions.

    Strata of one cell are trained on. The held-out part is the ceiling of its
    share, dealt to strata by largest remainders; within it, strata of which one
    cell was held out validate, and the test part is dealt among the others alike.
    """
    held = val_ratio + test_ratio
    if val_ratio < 0 or test_ratio < 0 or held >= 1:
        raise ValueError("ratios must not be negative, and sum to less than 1")
    if held == 0:
        return cells.select("cell_id", F.lit("train").alias("split"))
    rows = cells.select("cell_id", _stratum(by).alias("stratum"))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    usable = sizes.where("n > 1")
    whole = Window.partitionBy(F.lit(0))
    usable = usable.withColumn("total", F.ceil(F.round(F.sum("n").over(whole) * F.lit(held), 9)))
    usable = largest_remainder(usable, F.col("n"), F.col("total"), "held")
    two = usable.where("held > 1")
    two = two.withColumn("t", F.ceil(F.round(F.sum("held").over(whole) * F.lit(test_ratio / held), 9)))
    two = largest_remainder(two, F.col("held"), F.col("t"), "test").select("stratum", "test")
    quotas = sizes.select("stratum").join(usable.select("stratum", "held"), "stratum", "left").join(two, "stratum", "left")
    if val_ratio == 0:  # single held cells test too, where nothing validates
        quotas = quotas.withColumn("test", F.col("held"))
    quotas = quotas.fillna(0, ["held", "test"])
    ranked = ranked_by_hash(rows, "cell_id", seed, "stratum").join(F.broadcast(quotas), "stratum")
    split = F.when(F.col("rank") <= F.col("test"), "test").when(F.col("rank") <= F.col("held"), "val").otherwise("train")
    return ranked.select("cell_id", split.alias("split"))


def hvg_sample(cells: DataFrame, by: str, target_size: int = 300_000, min_cells: int = 100, seed: int = 42) -> DataFrame | None:
    """(cell_id) of a stratified sample of ``target_size``; None if there are no more cells.

    Strata of up to ``min_cells`` are kept whole; if these alone reach the target
    they are the sample. The others share the rest in proportion, by largest
    remainders.
    """
    rows = cells.select("cell_id", _stratum(by).alias("stratum"))
    if rows.limit(target_size + 1).count() <= target_size:
        return None
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= min_cells)
    kept = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k")).first().k
    quotas = small.select("stratum", F.col("n").alias("quota"))
    if kept < target_size:
        big = largest_remainder(sizes.where(F.col("n") > min_cells), F.col("n"), F.lit(target_size - kept), "quota")
        quotas = quotas.unionByName(big.select("stratum", "quota"))
    ranked = ranked_by_hash(rows, "cell_id", seed, "stratum").join(F.broadcast(quotas), "stratum")
    return ranked.where("rank <= quota").select("cell_id")


def subsample(cells: DataFrame, max_cells: int = 50_000, seed: int = 42) -> DataFrame | None:
    """(cell_id) of ``max_cells`` cells in hash order; None if there are no more."""
    if cells.limit(max_cells + 1).count() <= max_cells:
        return None
    ranked = ranked_by_hash(cells.select("cell_id"), "cell_id", seed)
    return ranked.where(F.col("rank") <= max_cells).select("cell_id")


def gene_dispersion(values: DataFrame, cells: DataFrame, genes: DataFrame, batch: str | None = None, bins: int = 20) -> DataFrame:
    """(batch, gene_id, mean, dispersion, normalized): of log-normalized values, within batches.

    Means and variances of ``expm1`` (zeros included, ddof 1); dispersions are
    logged and standardized within equal-width bins of the logged mean. A bin of one
    gene gives that gene 1.
    """
    label = F.col(batch).cast("string") if batch else F.lit("all")
    of = cells.select("cell_id", label.alias("batch"))
    n = of.groupBy("batch").agg(F.count("*").alias("n"))
    y = F.expm1(F.col("value"))
    sums = values.join(of, "cell_id").groupBy("batch", "gene_id").agg(F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    return dispersion_of_sums(sums, n, genes, bins)


def dispersion_of_sums(sums: DataFrame, n: DataFrame, genes: DataFrame, bins: int = 20) -> DataFrame:
    """``gene_dispersion`` from the sums (batch, gene_id, s, q) of ``expm1`` and its square, and the cells (batch, n)."""
    full = n.crossJoin(genes.select("gene_id")).join(sums, ["batch", "gene_id"], "left").fillna(0.0, ["s", "q"])
    mean = F.col("s") / F.col("n")
    variance = F.greatest(ratio(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0))
    safe = F.when(mean == 0, F.lit(1e-12)).otherwise(mean)
    spread = variance / safe
    stats = full.select("batch", "gene_id", F.log1p(mean).alias("mean"), F.when(spread > 0, F.log(spread)).alias("dispersion"))
    w = Window.partitionBy("batch")
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    # equal widths; the lowest edge belongs to the first bin, others to the bin below
    place = F.ceil(F.round(F.coalesce(ratio((F.col("mean") - low) * bins, high - low), F.lit(0.0)), 9))
    binned = stats.withColumn("bin", F.greatest(F.least(place, F.lit(bins)), F.lit(1)))
    b = Window.partitionBy("batch", "bin")
    avg, sd, k = F.avg("dispersion").over(b), F.stddev_samp("dispersion").over(b), F.count("dispersion").over(b)
    z = F.when(k <= 1, F.when(F.col("dispersion").isNotNull(), F.lit(1.0))).otherwise(ratio(F.col("dispersion") - avg, sd))
    return binned.select("batch", "gene_id", "mean", "dispersion", z.alias("normalized"))


def variable_genes(
    m: AnnotatedMatrix, batch: str | None = None, values_are: str = "counts", min_mean: float = 0.0125,
    max_mean: float = 3.0, min_disp: float = 0.5, top: int | None = None,
) -> DataFrame:
    """(gene_id, mean, dispersion, normalized, highly_variable), averaged over batches.

    Counts are normalized to the median depth first. With ``top``, the genes of
    highest normalized dispersion are chosen, ties by gene, instead of the cuts.
    """
    if batch is not None:
        m.require(batch)
    values = normalize(m, None) if values_are == "counts" else m.counts
    by_batch = gene_dispersion(values, m.cells, m.genes, batch)
    out = by_batch.groupBy("gene_id").agg(
        F.avg("mean").alias("mean"), F.avg("dispersion").alias("dispersion"),
        F.avg(F.coalesce("normalized", F.lit(0.0))).alias("normalized"),
    )
    if top is not None:
        k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("normalized").desc_nulls_last(), "gene_id"))
        return out.withColumn("highly_variable", k <= top)
    chosen = (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("normalized") > min_disp)
    return out.withColumn("highly_variable", F.coalesce(chosen, F.lit(False)))


def principal_components(m: AnnotatedMatrix, values: DataFrame, genes: DataFrame, k: int = 10) -> DataFrame:
    """(cell_id, vec): scores on the first ``k`` components of the chosen, centred genes.

    Rows stay distributed; only the genes' covariance (chosen genes squared) is on the driver.
    """
    column = genes.select("gene_id").withColumn("column", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_id")) - 1)
    width = column.count()
    n = m.cells.count()
    dense = dense_rows(m.cells, values, column, width)
    means = values.join(F.broadcast(column), "gene_id").groupBy("column").agg((F.sum("value") / n).alias("mean"))
    centre = [0.0] * width
    for r in means.collect():  # as many as chosen genes
        centre[r["column"]] = float(r["mean"])
    centred = dense.select("cell_id", array_to_vector(F.transform("row", lambda x, i: x - F.get(F.lit(centre), i))).alias("x"))
    model = PCA(k=min(k, width), inputCol="x", outputCol="pc").fit(centred)
    return model.transform(centred).select("cell_id", vector_to_array("pc").alias("vec"))


def split_stats(cells: DataFrame, counts: DataFrame, normalized: DataFrame) -> DataFrame:
    """(split, n_cells, nnz_counts, nnz_normalized, library_size_mean, library_size_median) of the three splits.

    ``cells`` have ``split`` and ``library_size``; an empty split has zeros.
    """
    names = cells.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    of = cells.select("cell_id", "split")

    def nonzero(values: DataFrame, name: str) -> DataFrame:
        return values.where("value != 0").join(of, "cell_id").groupBy("split").agg(F.count("*").alias(name))

    size = F.col("library_size").cast("double")
    stats = cells.groupBy("split").agg(
        F.count("*").alias("n_cells"), F.avg(size).alias("library_size_mean"), F.median(size).alias("library_size_median")
    )
    out = names.join(stats, "split", "left").join(nonzero(counts, "nnz_counts"), "split", "left")
    return out.join(nonzero(normalized, "nnz_normalized"), "split", "left").fillna(0)
