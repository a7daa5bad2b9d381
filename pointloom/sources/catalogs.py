"""Readers and generators of point catalogs; sinks for result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_points_f64(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(file, row, x0..): raw little-endian doubles, ``dim`` a point; an error if a file's size doesn't fit."""
    names = ["file", "row", *[f"x{i}" for i in range(dim)]]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(content) % (8 * dim):
                    raise ValueError(f"{file}: {len(content)} bytes are not points of {dim} doubles")
                x = np.frombuffer(content, "<f8").reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(x), pa.string()), pa.array(np.arange(len(x))), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(dim)]], names)

    schema = f"file string, row long, {', '.join(f'x{i} double' for i in range(dim))}"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


#: FITS table column codes and their big-endian types.
_FITS_TYPES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
_CARD, _BLOCK = 80, 2880


def _fits_header(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    cards: dict[str, str] = {}
    while at < len(raw):
        card = raw[at : at + _CARD].decode("ascii", "replace")
        at += _CARD
        if card.startswith("END"):
            return cards, -(-at // _BLOCK) * _BLOCK
        if card[8:9] == "=":
            cards[card[:8].strip()] = card[10:].split(" /")[0].strip().strip("'").strip()
    raise ValueError("a FITS header without END")


def fits_columns(raw: bytes, wanted: Sequence[str]) -> dict[str, np.ndarray | None]:
    """Numeric columns of the first binary table of a file, by name whatever the case; None where one is absent."""
    at = 0
    while at < len(raw):
        cards, at = _fits_header(raw, at)
        size = abs(int(cards.get("BITPIX", 8))) // 8 if int(cards.get("NAXIS", 0)) else 0
        for k in range(int(cards.get("NAXIS", 0))):
            size *= int(cards[f"NAXIS{k + 1}"])
        if cards.get("XTENSION") != "BINTABLE":
            at += -(-(size + int(cards.get("PCOUNT", 0))) // _BLOCK) * _BLOCK
            continue
        fields = []
        for k in range(1, int(cards["TFIELDS"]) + 1):
            form = cards[f"TFORM{k}"]
            count, code = form.rstrip("LXBIJKAEDCMPQ") or "1", form[len(form.rstrip("LXBIJKAEDCMPQ")) :][:1]
            n = int(count)
            kind = f"S{n}" if code == "A" else _FITS_TYPES[code] if n == 1 else f"({n},){_FITS_TYPES[code]}"
            fields.append((cards.get(f"TTYPE{k}", f"col{k}"), kind))
        rows = np.frombuffer(raw, np.dtype(fields), int(cards["NAXIS2"]), at)
        own = {name.lower(): name for name, _ in fields}
        return {w: rows[own[w.lower()]].astype(rows[own[w.lower()]].dtype.newbyteorder("=")) if w.lower() in own else None for w in wanted}
    raise ValueError("no binary table in the file")


def read_fits(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Numeric columns of FITS binary tables as doubles; null where a file lacks one."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                found = fits_columns(content, columns)
                n = next((len(v) for v in found.values() if v is not None), 0)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.float64()) if found[c] is None else pa.array(found[c].astype(float)) for c in columns], list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, ", ".join(f"`{c}` double" for c in columns))


def survey_catalog(rows: DataFrame, z_min: float, z_max: float) -> DataFrame:
    """(ra, dec, z, w): weight WEIGHT * WEIGHT_FKP if there, else the product of the component weights, else 1; in the redshift range, with finite positive weight."""
    have = {c.lower(): c for c in rows.columns}
    col = lambda name: F.col(have[name]) if name in have else F.lit(None).cast("double")
    parts = F.lit(1.0)
    for name in ("weight_sys", "weight_noz", "weight_comp_tile"):
        parts = parts * F.coalesce(col(name), F.lit(1.0))
    w = F.coalesce(col("weight"), parts) * F.coalesce(col("weight_fkp"), F.lit(1.0))
    out = rows.select(col("ra").alias("ra"), col("dec").alias("dec"), col("z").alias("z"), w.alias("w"))
    return out.where(F.col("z").between(z_min, z_max) & (F.col("w") > 0) & ~F.isnan("w") & (F.col("w") < F.lit(float("inf"))))


def halton(index: Column, base: int, digits: int = 40) -> Column:
    """Low-discrepancy number of an index."""
    steps = F.sequence(F.lit(1), F.lit(digits))
    start = F.struct(index.cast("long").alias("i"), F.lit(1.0).alias("f"), F.lit(0.0).alias("r"))
    step = lambda s, _: F.struct(F.floor(s["i"] / base).cast("long").alias("i"), (s["f"] / base).alias("f"), (s["r"] + s["f"] / base * (s["i"] % base)).alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["r"])


def uniform_box(spark: SparkSession, n: int, box: float, d: int = 3, seed: int = 42) -> DataFrame:
    """(id, x0..): n uniform points, from hashes of the ids and so the same for any partitioning."""
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(n).select("id", *[(u(i) * box).alias(f"x{i}") for i in range(d)])


def uniform_sky(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, ra, sin_dec): n uniform directions."""
    x = uniform_box(spark, n, 1.0, 2, seed)
    return x.select("id", (F.col("x0") * 360.0).alias("ra"), (2 * F.col("x1") - 1).alias("sin_dec"))


def galactic_latitude(ra: Column, dec: Column) -> Column:
    """Galactic latitude in degrees (pole at ra 192.85948, dec 27.12825)."""
    ra0, d0 = np.radians(192.85948), np.radians(27.12825)
    s = F.sin(F.radians(dec)) * float(np.sin(d0)) + F.cos(F.radians(dec)) * float(np.cos(d0)) * F.cos(F.radians(ra) - F.lit(float(ra0)))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def sampled_redshifts(points: DataFrame, data: DataFrame, edges: Sequence[float], z: str = "z", seed: int = 1) -> DataFrame:
    """Add a redshift drawn from the histogram of ``data`` on edges: inverse of the cumulative share, linear within a bin."""
    n = len(edges) - 1
    k = sum(F.when(F.col(z) >= F.lit(e), 1).otherwise(0) for e in edges[:-1]) - 1
    h = data.where((F.col(z) >= edges[0]) & (F.col(z) < edges[-1])).groupBy(k.alias("k")).agg(F.count("*").alias("c"))
    lows, highs = F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.array(*[F.lit(float(e)) for e in edges[1:]])
    order = Window.orderBy("k")  # one row a bin
    share = h.select("k", (F.sum("c").over(order) / F.sum("c").over(Window.partitionBy())).alias("top"), F.col("c")).select("k", "top", F.lag("top", 1, 0.0).over(order).alias("bottom"))
    table = share.select("top", "bottom", F.element_at(lows, F.col("k") + 1).alias("z0"), F.element_at(highs, F.col("k") + 1).alias("z1"))
    steps = F.array_sort(F.collect_list(F.struct("bottom", "top", "z0", "z1")))
    one = table.agg(steps.alias("_steps"))  # n bins in one row
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = points.crossJoin(F.broadcast(one)).withColumn("_u", u)
    hit = F.element_at(F.filter("_steps", lambda s: s["top"] > F.col("_u")), 1)
    assert n > 0
    return drawn.withColumn("z", hit["z0"] + (F.col("_u") - hit["bottom"]) / (hit["top"] - hit["bottom"]) * (hit["z1"] - hit["z0"])).drop("_steps", "_u")


def lattice(spark: SparkSession, n: int, box: float, d: int = 3) -> DataFrame:
    """(id, x0..): the centres of a regular grid of n^D cells."""
    ids = spark.range(n**d)
    return ids.select("id", *[((F.floor(F.col("id") / (n**i)) % n + 0.5) * (box / n)).alias(f"x{i}") for i in range(d)])


def allotted(total: int, shares: dict[str, int]) -> dict[str, int]:
    """``total`` dealt over regions in proportion to their counts, rounded down; the rest goes to the largest."""
    whole = sum(shares.values())
    out = {k: total * v // whole for k, v in shares.items()}
    out[max(sorted(shares), key=lambda k: shares[k])] += total - sum(out.values())
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_points_f64(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(part, content): the points of each partition as raw little-endian doubles, for a binary sink."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.stack([c.to_numpy(zero_copy_only=False).astype("<f8") for c in b.columns], axis=1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["content"])

    return df.select(*axes).mapInArrow(pack, "content binary").withColumn("part", F.spark_partition_id()).select("part", "content")
