"""Filtered, sorted and paged listings, and key merges of small tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numeric import exact_round

MOST_ROWS = 1000


@dataclass(frozen=True)
class Page:
    """A paging request: at most ``most`` rows; an unknown sort key means the default."""

    limit: int = 100
    offset: int = 0
    sort_by: str | None = None
    sort_order: str = "desc"
    columns: dict[str, str] = field(default_factory=dict)
    default: str = "id"
    most: int = MOST_ROWS

    def __post_init__(self):
        if not 1 <= self.limit <= self.most or self.offset < 0 or self.sort_order not in ("asc", "desc"):
            raise ValueError(f"limit is 1 to {self.most}, offset 0 or more, order asc or desc")

    @property
    def column(self) -> str:
        return self.columns.get(self.sort_by or "", self.default)


def paged(rows: DataFrame, page: Page, tie: str = "id") -> DataFrame:
    """A page of rows. Nulls come first when descending and last when ascending."""
    key = F.col(page.column)
    first = key.desc_nulls_first() if page.sort_order == "desc" else key.asc_nulls_last()
    return rows.orderBy(first, tie).offset(page.offset).limit(page.limit)


def experiments_page(experiments: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """The latest experiments, at most 200."""
    return paged(experiments, Page(limit, offset, most=200))


def misses_page(misses: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The misses of a run in the order of their ids, at most 1000."""
    return paged(misses, Page(limit, offset, sort_order="asc"))


def substring(column: str, wanted: str) -> Column:
    """Case-insensitive; % and _ stay wild cards."""
    return F.col(column).ilike(f"%{wanted}%")


def one_of(column: str, wanted: list) -> Column:
    return F.col(column).isin(*wanted)


def is_flag(column: str, wanted: bool) -> Column:
    return F.col(column).eqNullSafe(F.lit(wanted))


def within(column: str, first=None, last=None, strict: bool = False) -> Column:
    """A time range, its ends included unless strict."""
    if first is not None and last is not None and first > last:
        raise ValueError("the range ends before it begins")
    out = F.lit(True)
    if first is not None:
        out = out & ((F.col(column) > F.lit(first)) if strict else (F.col(column) >= F.lit(first)))
    if last is not None:
        out = out & ((F.col(column) < F.lit(last)) if strict else (F.col(column) <= F.lit(last)))
    return out


def has_error(column: str, wanted: bool) -> Column:
    return F.col(column).isNotNull() if wanted else F.col(column).isNull()


def json_text(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def holds(column: str, wanted: str) -> Column:
    """Whether a JSON array of texts holds a value; an array that isn't one holds none."""
    return F.coalesce(F.array_contains(F.from_json(F.col(column), "array<string>"), wanted), F.lit(False))


def absent_or_below(column: str, path: str, bound: int) -> Column:
    """Whether a whole number in a JSON text isn't there or is below a bound."""
    held = F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{path}", "int")
    return held.isNull() | (held < bound)


def elapsed(first: Column, last: Column) -> Column:
    """Seconds from one timestamp to another, one digit."""
    seconds = [F.unix_micros(t.cast("timestamp")) / 1e6 for t in (first, last)]
    return exact_round(seconds[1] - seconds[0], 1)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; LookupError if there is none."""
    found = rows.filter(F.col(key) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in the order of md5(key and seed): the same rows for the same seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def random_sample(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(n)


def first_of_equal(rows: DataFrame, key: str | Column, order: str | Column) -> DataFrame:
    """One row for each key, the one that comes first by ``order``; partial minima."""
    named = rows.withColumn("_key", F.col(key) if isinstance(key, str) else key)
    first = named.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return first.select("_row.*")


def insert_new(existing: DataFrame, fresh: DataFrame, key: str, order: str | Column | None = None) -> DataFrame:
    """Rows of fresh whose key the table doesn't have; of equal keys the first by
    ``order`` counts, which rows with unequal keys can do without."""
    once = fresh.dropDuplicates([key]) if order is None else first_of_equal(fresh, key, order)
    return once.join(existing.select(key), key, "left_anti").select(*fresh.columns)


def upsert(existing: DataFrame, fresh: DataFrame, key: str, order: str | Column | None = None) -> DataFrame:
    """existing with the rows of fresh in place of those with the same key; of equal keys
    in fresh the last by ``order`` counts, as each replaces the one before."""
    if order is None:
        fresh = fresh.dropDuplicates([key])
    else:
        fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*fresh.columns), order).alias("_row")).select("_row.*")
    return existing.join(fresh.select(key), key, "left_anti").select(*existing.columns).unionByName(fresh.select(*existing.columns))


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name."""
    return reduce(DataFrame.unionByName, parts)


def union_of(*names: DataFrame) -> DataFrame:
    """The different rows of all parts."""
    return concatenated(*names).distinct()


def missing_from(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """The different wanted rows that present lacks."""
    return wanted.subtract(present.select(*wanted.columns))


def activate(prompts: DataFrame, purpose: str, target: int) -> DataFrame:
    """One active prompt for a purpose: the target, and none of its siblings."""
    return prompts.withColumn("active", F.when(F.col("purpose") == purpose, F.col("id") == target).otherwise(F.col("active")))


def freshest(prompts: DataFrame) -> DataFrame:
    """The latest version of each purpose that has no active prompt."""
    taken = prompts.filter("active").select("purpose")
    return prompts.join(taken, "purpose", "left_anti").groupBy("purpose").agg(F.max("version").alias("version"), F.max_by("id", "version").alias("id"))


def next_version(prompts: DataFrame, purpose: str) -> DataFrame:
    return prompts.filter(F.col("purpose") == purpose).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def guarded_delete(rows: DataFrame, key: str, value, references: DataFrame, foreign: str) -> DataFrame:
    """rows without the one that has the key, those with a null key included; ValueError while another table uses it."""
    if not references.filter(F.col(foreign) == F.lit(value)).isEmpty():
        raise ValueError(f"{value!r} is in use")
    return rows.filter(~F.col(key).eqNullSafe(F.lit(value)))


def cascade(children: DataFrame, foreign: str, gone: DataFrame, key: str) -> DataFrame:
    """children whose parent still stands."""
    return children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*children.columns)


def conclude(experiments: DataFrame, identity: int, conclusion: str) -> DataFrame:
    """Conclude an experiment, which has to be aggregated."""
    row = lookup(experiments, "id", identity).first()
    if row["status"] != "aggregated":
        raise ValueError(f"cannot conclude from {row['status']}")
    own = F.col("id") == identity
    return experiments.withColumn("status", F.when(own, "concluded").otherwise(F.col("status"))).withColumn("conclusion", F.when(own, conclusion).otherwise(F.col("conclusion")))
