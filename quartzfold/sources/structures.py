"""Structure files, secondary-structure files and embedding files as tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfold.constants import MAX_SURFACE


def read_lines(spark: SparkSession, path: str, pattern: str = "*.pdb") -> DataFrame:
    """variant_id (the file name without its last suffix), line_no, line, path of every file below ``path`` that matches."""
    whole = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    # file names come with their special characters escaped, as in addresses
    plain = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(plain, r"\.[^.]*$", "")
    lines = whole.select(name.alias("variant_id"), F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), "\r\n|\n")).alias("line_no", "line"))
    return lines.select("variant_id", "line_no", "line", "path")


def atoms(lines: DataFrame) -> DataFrame:
    """The atom lines as columns, with the model (from 0) and the order of chains within it (from 0)."""
    by_line = Window.partitionBy("variant_id").orderBy("line_no")
    model = F.greatest(F.sum(F.col("line").startswith("MODEL").cast("int")).over(by_line) - 1, F.lit(0))
    at = lines.withColumn("model_idx", model).where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    cut = lambda start, n: F.trim(F.substring("line", start, n))
    number = lambda start, n: cut(start, n).try_cast("double")
    out = at.select(
        "variant_id", "model_idx", F.substring("line", 22, 1).alias("chain_id"), F.when(F.col("line").startswith("HETATM"), "H").otherwise(" ").alias("hetflag"), cut(23, 4).try_cast("int").alias("resseq"),
        cut(27, 1).alias("icode"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom_name"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("bfactor"), "line_no", "line",
    )
    first = out.groupBy("variant_id", "model_idx", "chain_id").agg(F.min("line_no").alias("_first"))
    ranked = first.withColumn("chain_ord", F.row_number().over(Window.partitionBy("variant_id", "model_idx").orderBy("_first")) - 1).drop("_first")
    return out.join(ranked, ["variant_id", "model_idx", "chain_id"])


def one_location(atom_rows: DataFrame) -> DataFrame:
    """``atom_rows`` with one row per atom: of alternate locations the one of the highest occupancy, the first of equal ones."""
    key = ["variant_id", "model_idx", "chain_id", "hetflag", "resseq", "icode", "resname", "atom_name"]
    occupancy = F.coalesce(F.trim(F.substring("line", 55, 6)).try_cast("double"), F.lit(0.0)).alias("occupancy")
    others = [c for c in atom_rows.columns if c not in key]
    best = atom_rows.groupBy(key).agg(F.max(F.struct(occupancy, (-F.col("line_no")).alias("order"), *others)).alias("_a"))
    return best.select(*[F.col(c) if c in key else F.col(f"_a.{c}") for c in atom_rows.columns])


def alpha_coordinates(atom_rows: DataFrame, model: int = 0) -> DataFrame:
    """variant_id and coords: x, y, z of all CA atoms of a model in line order, as one array."""
    ca = one_location(atom_rows.where((F.col("atom_name") == "CA") & (F.col("model_idx") == model))).groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.array("x", "y", "z").alias("p")))).alias("a"))
    return ca.select("variant_id", F.flatten(F.transform("a", lambda s: s["p"])).alias("coords"))


def atom_names(text: str) -> tuple[str, ...]:
    """The atom names of a list such as ``N, CA,c``: in upper case, each once, in order; ValueError for none."""
    names = tuple(dict.fromkeys(n for n in (x.strip().upper() for x in text.split(",")) if n))
    if not names:
        raise ValueError("no atom names")
    return names


def backbone(atom_rows: DataFrame, align: tuple[str, ...] = ("CA",), averaged: tuple[str, ...] = ("N", "CA", "C")) -> DataFrame:
    """variant_id, coords (``align`` atoms), moved (``averaged`` atoms of the residues that have all of them), layout and lines (those of ``moved``).

    Of the first model and chain, without hetero residues, in order of residues that have all ``align`` atoms; of repeated
    atoms the one of the highest occupancy. Where no residue has all ``averaged`` atoms, ``moved`` is the ``align`` atoms
    alone, and ``layout`` says so.
    """
    names = tuple(dict.fromkeys([*align, *averaged]))
    mine = one_location(atom_rows.where("model_idx = 0 and chain_ord = 0 and hetflag = ' '").where(F.col("atom_name").isin(*names)))
    atom = F.struct("line_no", F.array("x", "y", "z").alias("at"))
    each = mine.groupBy("variant_id", "resseq", "icode").agg(F.min("line_no").alias("start"), *[F.max(F.when(F.col("atom_name") == n, atom)).alias(f"a{i}") for i, n in enumerate(names)])
    of = lambda some: F.array(*[F.col(f"a{names.index(n)}") for n in some])
    has = lambda some: F.forall(of(some), lambda a: a.isNotNull())
    rows = each.where(has(align)).groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct("start", of(align).alias("fixed"), F.when(has(averaged), of(averaged)).alias("own")))).alias("r"))
    fixed = F.flatten(F.transform("r", lambda s: s["fixed"]))
    own = F.flatten(F.transform(F.filter("r", lambda s: s["own"].isNotNull()), lambda s: s["own"]))
    place = lambda atoms: F.flatten(F.transform(atoms, lambda a: a["at"]))
    rows = rows.select("variant_id", fixed.alias("fixed"), own.alias("own")).withColumn("all", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("fixed")))
    layout = F.when(F.size("own") > 0, ", ".join(averaged)).otherwise(f"{', '.join(align)} alone")
    return rows.select("variant_id", place(F.col("fixed")).alias("coords"), place(F.col("all")).alias("moved"), layout.alias("layout"), F.transform("all", lambda a: a["line_no"]).alias("lines"))


def residues(lines: DataFrame) -> DataFrame:
    """Residues of secondary-structure files in the classic fixed-width layout: variant_id, dssp_index, resseq, aa, ss, acc, rasa.

    Rows follow the line whose third character is ``#``; chain breaks (``!``) are left out, lower-case letters (bridged
    cysteines) are C. ``rasa`` is the surface as a share of the residue's largest, at most 1, null for unknown residues.
    """
    head = lines.where(F.substring("line", 3, 1) == "#").groupBy("variant_id").agg(F.min("line_no").alias("_head"))
    rows = lines.join(head, "variant_id").where((F.col("line_no") > F.col("_head")) & (F.substring("line", 14, 1) != "!"))
    aa = F.substring("line", 14, 1)
    largest = F.create_map(*[F.lit(x) for pair in MAX_SURFACE.items() for x in pair])
    out = rows.select(
        "variant_id", F.trim(F.substring("line", 1, 5)).try_cast("int").alias("dssp_index"), F.trim(F.substring("line", 6, 5)).try_cast("int").alias("resseq"),
        F.when(aa.rlike("[a-z]"), "C").otherwise(aa).alias("aa"), F.substring("line", 17, 1).alias("ss"), F.trim(F.substring("line", 35, 4)).try_cast("double").alias("acc"),
    )
    share = F.col("acc") / F.element_at(largest, F.col("aa"))
    return out.withColumn("rasa", F.when(share.isNotNull(), F.least(share, F.lit(1.0))))


def read_vectors(spark: SparkSession, path: str, key: str = "emb") -> DataFrame:
    """Rows of the two-dimensional array ``key`` of each ``.npz`` file: variant_id, pos (from 0), vec, or a reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)[key]
                    if a.ndim != 2:
                        raise ValueError(f"{a.ndim} dimensions instead of 2")
                    yield pd.DataFrame({"variant_id": name, "pos": range(len(a)), "vec": list(a.astype(np.float32)), "reason": None})
                except (KeyError, ValueError, OSError) as e:
                    yield pd.DataFrame({"variant_id": [name], "pos": [None], "vec": [None], "reason": [f"{type(e).__name__}: {e}"]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.npz$", "").alias("name"), "content")
    return named.mapInPandas(run, "variant_id string, pos int, vec array<float>, reason string")
