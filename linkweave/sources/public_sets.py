"""Public drug repurposing benchmarks from their files, as long tables (ratings, users, items).

ratings: (item, user, rating int) of all pairs; users and items: (id, feature, value double) of all cells. Missing values are 0.
A matrix file is one task's, read in lots of lines; matrices of MATLAB files are a task a variable. Where a set has no names, items
are drug1, drug2, .. and users disease1, disease2, ..

Files of the sets, in one folder each (fixed values):
TRANSCRIPT, TRANSCRIPT_v1, PREDICT, PREDICT_v1: ratings_mat.csv, users.csv, items.csv;
LRSSL: drug_dis_mat.txt, disease_similarity.txt, drug_pubchem_mat.txt, drug_target_domain_mat.txt;
LRSSL2, PREDICT_Gottlieb: LRSSL.mat, PREDICT.mat; Gottlieb, Fdataset: DiDrAMat, DiseaseSimMat, DrugSimMat, DrugsName, DiseasesName;
Cdataset_Aonly: DrDiMat, DrugsName, DiseasesName; Cdataset, DNdataset: DiDrA.txt, DiseaseSim.txt, DrugSim.txt (for Cdataset also the
names); indep: DiDrMat.mat, R_Wrname, R_Wdname.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matlab


def cells(spark: SparkSession, path: str, sep: str, named: bool) -> DataFrame:
    """(row, column, row_name, column_name, value) of a wide text file; named: the first line and column are names."""

    def read(parts):
        for pdf in parts:
            for content in pdf.content:
                at = 0
                lots = pd.read_csv(io.BytesIO(content), sep=sep, header=0 if named else None, index_col=0 if named else None, engine="python" if len(sep) > 1 else "c", chunksize=1000, dtype={0: str} if named else None)
                for lot in lots:
                    lot = lot.reset_index(drop=not named)
                    names = lot.iloc[:, 0].astype(str) if named else pd.Series([None] * len(lot), dtype=object)
                    values = lot.iloc[:, 1:] if named else lot
                    width = values.shape[1]
                    columns = [str(c) if named else None for c in values.columns]
                    yield pd.DataFrame({
                        "row": (at + pd.Series(range(len(lot)))).repeat(width).to_numpy(), "column": list(range(width)) * len(lot), "row_name": names.repeat(width).to_numpy(), "column_name": columns * len(lot),
                        "value": pd.to_numeric(pd.Series(values.to_numpy().ravel()), errors="coerce").to_numpy(),
                    })
                    at += len(lot)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, "row long, column long, row_name string, column_name string, value double")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(at, name): the names of a file, one a line."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")
    return text.select(F.posexplode(lines).alias("at", "name")).select(F.col("at").cast("long").alias("at"), F.trim("name").alias("name"))


def _flipped(c: DataFrame) -> DataFrame:
    return c.select(F.col("column").alias("row"), F.col("row").alias("column"), F.col("column_name").alias("row_name"), F.col("row_name").alias("column_name"), "value")


def _named(c: DataFrame, side: str, known: DataFrame | None, word: str | None) -> DataFrame:
    """c with side_name from the names at its places, or numbered ones."""
    if known is None:
        return c.withColumn(f"{side}_name", F.concat(F.lit(word), (F.col(side) + 1).cast("string")))
    return c.drop(f"{side}_name").join(F.broadcast(known.select(F.col("at").alias(side), F.col("name").alias(f"{side}_name"))), side, "left")  # names of one file


def _ratings(c: DataFrame) -> DataFrame:
    value = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    return c.select(F.col("row_name").alias("item"), F.col("column_name").alias("user"), value.cast("int").alias("rating"))


def _features(c: DataFrame) -> DataFrame:
    """Features are rows, ids columns."""
    value = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    return c.select(F.col("column_name").alias("id"), F.col("row_name").alias("feature"), value.alias("value"))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, feature string, value double")


def _mat(spark, path: str, variable: str) -> DataFrame:
    matlab.register(spark)
    rows = spark.read.format("mat5").option("variables", variable).load(path)
    none = F.lit(None).cast("string")
    return rows.select("row", "column", none.alias("row_name"), none.alias("column_name"), "value")


def _stacked(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Feature rows of several similarity matrices, named by kind and drug."""
    out = None
    for kind, c in parts:
        one = _named(c, "column", None, "drug").withColumn("row_name", F.concat(F.lit(f"{kind}-drug"), (F.col("row") + 1).cast("string")))
        out = one if out is None else out.unionByName(one)
    return out


def load(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings, users, items) of a set whose files are in folder."""
    at = lambda file: f"{folder}/{file}"
    if name in ("TRANSCRIPT", "TRANSCRIPT_v1", "PREDICT", "PREDICT_v1"):
        a, p, s = (cells(spark, at(f), ",", True) for f in ("ratings_mat.csv", "users.csv", "items.csv"))
        return _ratings(a), _features(p), _features(s)
    if name == "LRSSL":
        a, p = (cells(spark, at(f), "\t", True) for f in ("drug_dis_mat.txt", "disease_similarity.txt"))
        users = p.where("row = 0").select(F.col("column").alias("at"), F.col("column_name").alias("name"))
        drugs = a.select(F.col("row_name").alias("id")).distinct()
        parts = [cells(spark, at(f), "\t", True).select(F.col("row_name").alias("id"), F.col("column_name").alias("feature"), "value") for f in ("drug_pubchem_mat.txt", "drug_target_domain_mat.txt")]
        held = parts[0].unionByName(parts[1]).join(drugs, "id", "left_semi")
        every = drugs.join(F.broadcast(held.select("feature").distinct()))  # the features of two files
        items = every.join(held, ["id", "feature"], "left").select("id", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
        return _ratings(_named(a, "column", users, None)), _features(p), items
    if name in ("LRSSL2", "PREDICT_Gottlieb"):
        first = name == "LRSSL2"
        file = at("LRSSL.mat" if first else "PREDICT.mat")
        # The variables of the two files.
        a, p, *s = ("lrssladmatdgc", "lrsslsimmatdg", "lrsslsimmatdcchemical", "lrsslsimmatdcgo") if first else ("predictAdMatdgc", "predictSimMatdg", "predictSimMatdcChemical", "predictSimMatdcDomain", "predictSimMatdcGo")
        ratings = _mat(spark, file, a) if first else _flipped(_mat(spark, file, a))
        similar = _named(_named(_mat(spark, file, p), "row", None, "disease"), "column", None, "disease")
        items = _stacked(list(zip(("chemical", "se") if first else ("chemical", "domain", "go"), (_mat(spark, file, v) for v in s))))
        return _ratings(_named(_named(ratings, "row", None, "drug"), "column", None, "disease")), _features(similar), _features(items)
    if name in ("Gottlieb", "Fdataset", "Cdataset"):
        plain = name == "Cdataset"
        a, p, s = ("DiDrA.txt", "DiseaseSim.txt", "DrugSim.txt") if plain else ("DiDrAMat", "DiseaseSimMat", "DrugSimMat")
        drugs, diseases = (names(spark, at(f)) for f in ("DrugsName", "DiseasesName"))
        ratings = _flipped(cells(spark, at(a), "\t", False))
        ratings = ratings if plain else ratings.join(F.broadcast(drugs.select(F.col("at").alias("row"))), "row", "left_semi")  # lines end with a tab
        side = lambda file, known: _features(_named(_named(cells(spark, at(file), "\t" if plain else " ", False), "row", known, None), "column", known, None))
        return _ratings(_named(_named(ratings, "row", drugs, None), "column", diseases, None)), side(p, diseases), side(s, drugs)
    if name == "DNdataset":
        number = lambda c: c.withColumns({"row_name": F.col("row").cast("string"), "column_name": F.col("column").cast("string")})
        a, p, s = (number(cells(spark, at(f), "\t", False)) for f in ("DiDrA.txt", "DiseaseSim.txt", "DrugSim.txt"))
        return _ratings(_flipped(a)), _features(p), _features(s)
    if name in ("Cdataset_Aonly", "indep"):
        a = cells(spark, at("DrDiMat"), "\t", False) if name == "Cdataset_Aonly" else _flipped(_mat(spark, at("DiDrMat.mat"), "R_Wdr"))
        files = ("DrugsName", "DiseasesName") if name == "Cdataset_Aonly" else ("R_Wrname", "R_Wdname")
        drugs, diseases = (names(spark, at(f)) for f in files)
        a = a.join(F.broadcast(diseases.select(F.col("at").alias("column"))), "column", "left_semi")  # lines end with a tab
        return _ratings(_named(_named(a, "row", drugs, None), "column", diseases, None)), _none(spark), _none(spark)
    raise ValueError(f"unknown set {name}")
