"""A gazetteer of places: keys that spellings have in common, country filter, search, and the resolver of a single place."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the published table of urban regions, and their names and types here.
FIELDS = {
    "SMOD_ID": ("place_id", "string"), "JRC_NAME_MAIN": ("name", "string"), "ISO": ("iso", "string"), "CNTRY_NAME": ("country", "string"),
    "minx": ("x0", "double"), "miny": ("y0", "double"), "maxx": ("x1", "double"), "maxy": ("y1", "double"),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The gazetteer file as a frame with `ord`, its order in the file; a file without one of the columns raises."""
    table = spark.read.csv(path, header=True)
    if missing := [c for c in FIELDS if c not in table.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return table.select(*[F.col(c).cast(kind).alias(name) for c, (name, kind) in FIELDS.items()], F.monotonically_increasing_id().alias("ord"))


def key_of(value: str) -> str:
    """A name without marks, case and all that is no ASCII letter or digit."""
    letters = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return "".join(c for c in letters.casefold() if c.isascii() and c.isalnum())


def _keys(names: pd.Series) -> pd.Series:
    return names.map(key_of, na_action="ignore")


def name_key(name: Column) -> Column:
    """`key_of` of a column; only names that aren't all ASCII have work to do in Python."""
    odd = F.when(name.rlike(r"[^\x00-\x7F]"), name)
    return F.coalesce(F.pandas_udf(_keys, T.StringType())(odd), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))


def in_country(places: DataFrame, country: str | None) -> DataFrame:
    """Places whose ISO code or country begins with `country`, as keys; all of them without one."""
    wanted = key_of(country or "")
    return places.where(name_key(F.col("iso")).startswith(wanted) | name_key(F.col("country")).startswith(wanted)) if wanted else places


def find(places: DataFrame, query: str, country: str | None = None) -> DataFrame:
    """Places whose key is the query's (tier 0) or contains it (tier 1); file order inside a tier is `ord`. An empty query finds all."""
    wanted = key_of(query)
    keyed = in_country(places, country).withColumn("key", name_key(F.col("name")))
    return keyed.where(F.col("key").contains(wanted) if wanted else F.lit(True)).withColumn("tier", F.when(F.col("key") == wanted, 0).otherwise(1)).drop("key")


def resolve(places: DataFrame, query: str, country: str | None = None, listed: int = 8) -> Row:
    """The one place of the best tier; none, or several, raise LookupError, which names `listed` of them at most."""
    found = find(places, query, country)
    tier = found.agg(F.min("tier")).first()[0]
    if tier is None:
        raise LookupError(f"no place is called {query!r}" + (f" in {country}" if country else ""))
    tied = found.where(F.col("tier") == tier)
    first = tied.orderBy("ord").limit(listed).collect()
    if len(first) > 1:
        more = tied.count() - len(first)
        raise LookupError(f"{query!r} names several places: " + "; ".join(f"{r['name']} ({r['iso']})" for r in first) + (f"; and {more} more" if more else ""))
    return first[0]
