"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Each document gets a vector of transformed text statistics. For each group (language, source) the
minimum-covariance-determinant estimate is found by concentration steps: a step takes the half of
the group's rows that lie nearest under the present estimate, and estimates mean and covariance from
them, until the determinants settle. Two starts are run side by side and the smaller determinant
wins: medians with median deviations, and the mean and covariance of the rows' directions from the
medians. Equal vectors of a group count once in its estimate, so copies of a text, junk or not, cannot
draw it to them. The rows near the half that is found give the final estimate.

The same is done for all rows as one group. A group's mean and covariance are drawn to those of all
rows by ``prior_rows`` rows' worth, so small groups lean on the whole and large ones stand by
themselves, without a limit between the two. All statistics are logarithms or square roots of counts,
on whose scale a count out of n has the sampling variance 1 / (4 n). That variance, of the document
itself, is added to the covariance: it keeps directions regular in which a group does not vary, and a
short text needs more than a long one to stand out. Documents beyond a chi-square bound are rejected.

No step gathers a group: rows are summed per distance bin (counts, sums and products, combined
before the shuffle), and running sums over the bins of a group give the nearest part. A bin is 4.4 %
of a squared distance wide; of the last one its share is taken, so rows at one distance are split.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from stridelake.llm.common import small, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The vector's statistics: logarithms of word length and size, square roots of shares.
VECTOR = ("length", "symbols", "marks", "duplicates", "repeats", "size")
#: Words that one repeated window brings: repeated words are counted in threes.
_REPEAT = 3
_COUNTS = (*BASE, "n_lines", "n_marks")
_P = len(VECTOR)
#: Rows within this part of the chi-square distribution give the final estimate.
_NEAR = 0.975
#: The key of all rows as one group; keys of groups are JSON objects.
_ALL = "all"
#: So many groups, of 400 bytes, are broadcast.
_FEW = 50_000
_DROP = bytes(set(range(256)) - set(b"#*$%&|<>"))
_CONTINUED = bytes(range(0x80, 0xC0))


def statistics(text: bytes) -> tuple[int, ...]:
    """The five base counts, the number of lines with a word, and that of exclamation and question marks."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(_COUNTS)
    chars = len(b"".join(words).translate(None, _CONTINUED))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else [text]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = set(windows)
        if len(seen) < len(windows):
            often = Counter(windows)
            reach = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    return n, chars, len(text.translate(None, _DROP)), len(lines) - len(set(lines)), repeated, len(lines), text.count(b"!") + text.count(b"?")


def vectors(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of rows of counts, and the sampling variances of each."""
    n, chars, symbols, duplicates, repeats, lines, marks = counts.reshape(-1, len(_COUNTS)).T.astype(float)
    words, letters, rows = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    x = np.stack([np.log((chars + 1) / words), np.sqrt(symbols / letters), np.sqrt(marks / letters), np.sqrt(duplicates / rows), np.sqrt(repeats / words), np.log(words) / 2], 1)
    return x, 0.25 / np.stack([words, letters, letters, rows, words / _REPEAT, words], 1)


def _counted(texts: pa.Array) -> np.ndarray:
    raw = texts.cast(pa.binary()).fill_null(b"")
    return np.array([statistics(x.as_buffer().to_pybytes()) for x in raw], np.int64).reshape(-1, len(_COUNTS))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a struct __s of the counts and arrays __x, __v of the vector and its sampling variances."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _counted(b.column(place))
            x, v = (pa.array(m.tolist(), pa.list_(pa.float64())) for m in vectors(counts))
            s = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts.T], list(_COUNTS))
            left = [i for i in range(b.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in left), s, x, v], [*(b.schema.names[i] for i in left), "__s", "__x", "__v"])

    fields = [f for i, f in enumerate(docs.schema.fields) if i != place]
    counts = StructType([StructField(n, LongType()) for n in _COUNTS])
    numbers = ArrayType(DoubleType())
    return docs.mapInArrow(run, StructType([*fields, StructField("__s", counts), StructField("__x", numbers), StructField("__v", numbers)]))


def _failed() -> Column:
    s = F.col("__s")
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def _lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_cdf(x: float, p: int) -> float:
    return _lower_gamma(p / 2, x / 2)


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(min(mid, 1400.0), p) < q else (lo, mid)
    return (lo + hi) / 2


def _distance(mu: str, w: str) -> str:
    """SQL of the squared length of the whitened vector; w is a lower triangle, row by row."""
    rows = [" + ".join(f"{w}[{i * (i + 1) // 2 + j}] * (x{j} - {mu}[{j}])" for j in range(i + 1)) for i in range(_P)]
    return " + ".join(f"power({r}, 2)" for r in rows)


_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_SUMMED = ["n", *[f"s{i}" for i in range(_P)], *[f"v{i}" for i in range(_P)], *[f"p{i}{j}" for i, j in _PAIRS]]
_TRIANGLE = [i * _P + j for i, j in _PAIRS]


_FIT = "g string, start int, n long, mu array<double>, cov array<double>, w array<double>, logdet double, fell boolean"
#: An estimate has settled when its determinant falls by less than this part.
_SETTLED = 0.01


def spread(part: float) -> float:
    """By how much the covariance of a normal group exceeds that of its nearest ``part``."""
    return part / chi2_cdf(chi2_quantile(part, _P), _P + 2) if part < 1 else 1.0


def _sums() -> list[Column]:
    sums = [f"sum({c}{i}) AS {d}{i}" for c, d in (("x", "s"), ("n", "v")) for i in range(_P)] + [f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in _PAIRS]
    return [F.expr("count(*) AS n"), *map(F.expr, sums)]


def _solve(rows: DataFrame, part: str) -> DataFrame:
    """(g, start, n, mu, cov, w, logdet, fell) of (g, start, sums, was), one row for each group, whose summed rows are its nearest ``part``.

    cov is the covariance of the rows, as a lower triangle; w whitens by it and the rows' mean sampling variance, whose determinant is meant.
    ``was`` is the determinant of the estimate before; fell says whether this one is smaller by enough to go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2, b.num_columns)], 1)
            n, sums, noise, products, parts, was = t[:, :1], t[:, 1 : 1 + _P], t[:, 1 + _P : 1 + 2 * _P], t[:, 1 + 2 * _P : -2], t[:, -2], t[:, -1]
            mu = sums / n
            cov = np.zeros((len(t), _P, _P))
            for at, (i, j) in enumerate(_PAIRS):
                cov[:, i, j] = cov[:, j, i] = products[:, at] / n[:, 0] - mu[:, i] * mu[:, j]
            cov *= np.array([spread(x) for x in parts]).reshape(-1, 1, 1)
            # rounding may leave an eigenvalue just below zero
            value, vector = np.linalg.eigh(cov)
            cov = (vector * np.maximum(value, 0.0)[:, None, :]) @ vector.transpose(0, 2, 1)
            whole = cov + np.eye(_P) * (noise / n)[:, None, :]
            w = np.linalg.inv(np.linalg.cholesky(whole))
            f = pa.list_(pa.float64())
            flat = lambda m: pa.array(m.reshape(len(t), -1)[:, _TRIANGLE].tolist(), f)
            logdet = np.linalg.slogdet(whole)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n[:, 0].astype(np.int64)), pa.array(mu.tolist(), f), flat(cov), flat(w), pa.array(logdet), pa.array(logdet < was - _SETTLED)], ["g", "start", "n", "mu", "cov", "w", "logdet", "fell"])

    return rows.selectExpr("g", "start", *_SUMMED, f"CAST({part} AS double) AS part", "was").mapInArrow(run, _FIT)


def _group(names: list[str]) -> Column:
    """One key for the group columns; nulls are a value of their own."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(names)]), {"ignoreNullFields": "false"})


def _medians(rows: DataFrame) -> DataFrame:
    """(g, m0 ..., d0 ...): medians and median deviations of each group, from counts of narrow bins."""
    bins = rows.selectExpr("g", f"posexplode(array({', '.join(f'CAST(floor(x{i} * 64) AS bigint)' for i in range(_P))})) AS (f, bin)").groupBy("g", "f", "bin").agg(F.expr("count(*) AS c"))
    bins = written(bins)

    def middle(df: DataFrame, order: str) -> DataFrame:
        summed = df.selectExpr("g", "f", order, f"sum(c) OVER (PARTITION BY g, f ORDER BY {order}) AS to", "sum(c) OVER (PARTITION BY g, f) AS all_")
        return summed.groupBy("g", "f").agg(F.expr(f"min(CASE WHEN 2 * to >= all_ THEN {order} END) AS at"))

    middles = middle(bins, "bin").selectExpr("g", "f", "at AS m")
    off = middle(bins.join(middles, ["g", "f"]).withColumn("off", F.expr("abs(bin - m)")), "off").selectExpr("g", "f", "at AS off")
    wide = [F.expr(x) for i in range(_P) for x in (f"max(CASE WHEN f = {i} THEN (m + 0.5D) / 64 END) AS m{i}", f"max(CASE WHEN f = {i} THEN off / 64 * 1.4826D END) AS o{i}")]
    noise = rows.groupBy("g").agg(*[F.expr(f"sqrt(avg(n{i})) AS e{i}") for i in range(_P)])
    found = middles.join(off, ["g", "f"]).groupBy("g").agg(*wide).join(noise, "g")
    return written(found.selectExpr("g", *[f"m{i}" for i in range(_P)], *[f"greatest(o{i}, e{i}) AS d{i}" for i in range(_P)]))


def estimate(rows: DataFrame, prior_rows: int = 40, steps: int = 40) -> DataFrame:
    """(group, mu, cov) for every group of (group, x0 ..., n0 ...): vectors and their sampling variances.

    Equal rows of a group count once. ``cov`` is a lower triangle. Means and covariances are drawn to
    those of all rows by the weight of ``prior_rows`` rows. A group's steps end when its
    determinant has settled, or after ``steps``, and its least one wins. No rows: no groups.
    """
    cols = [f"{c}{i}" for c in "xn" for i in range(_P)]
    rows = written(rows.select("group", *cols).distinct().selectExpr(f"explode(array(group, '{_ALL}')) AS g", *cols))
    wide = _medians(rows)
    # a row for each group and start: with few groups no row of theirs is shuffled to meet it
    near_by = F.broadcast if wide.limit(_FEW + 1).count() <= _FEW else lambda df: df
    mids = f"array({', '.join(f'm{i}' for i in range(_P))})"
    diagonal = lambda x: f"array({', '.join(x.format(i) if i == j else '0.0D' for i, j in _PAIRS)})"
    first = wide.selectExpr("g", "0 AS start", "0L AS n", f"{mids} AS mu", f"{diagonal('power(d{}, 2)')} AS cov", f"{diagonal('1 / d{}')} AS w", "double('infinity') AS logdet", "true AS fell")
    # start 1: all rows, drawn to one distance from the medians
    far = f"greatest(sqrt({' + '.join(f'power((x{i} - m{i}) / d{i}, 2)' for i in range(_P))}), 1e-9D)"
    drawn = rows.join(near_by(wide), "g").withColumn("far", F.expr(far)).selectExpr("g", *[f"m{i} + (x{i} - m{i}) / far * {math.sqrt(_P)}D AS x{i}" for i in range(_P)], *[f"n{i}" for i in range(_P)])
    unknown = "double('infinity') AS was"
    now = written(first.unionByName(_solve(drawn.groupBy("g").agg(*_sums()).selectExpr("*", "1 AS start", unknown), "1")))
    bins = f"CAST(floor(log2({_distance('mu', 'w')} + 1e-9D) * 16) AS int) AS bin"
    below = "OVER (PARTITION BY g, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    found = None
    for _ in range(steps):
        met = rows.join(near_by(now.select("g", "start", "mu", "w")), "g")
        counts = met.selectExpr("g", "start", bins, *cols).groupBy("g", "start", "bin").agg(*_sums())
        total = counts.selectExpr("*", "sum(n) OVER (PARTITION BY g, start) AS all_", *[f"coalesce(sum({c}) {below}, 0) AS u{c}" for c in _SUMMED])
        core = total.withColumn("core", F.expr(f"least(floor((all_ + {_P} + 1) / 2), all_)")).where("un < core AND un + n >= core")
        half = core.withColumn("share", F.expr("(core - un) / n")).selectExpr("g", "start", "core / all_ AS part", *[f"u{c} + {c} * share AS {c}" for c in _SUMMED])
        now = written(_solve(half.join(now.selectExpr("g", "start", "logdet AS was"), ["g", "start"]), "part"))
        found = now if found is None else found.unionByName(now)
        now = now.where("fell")
        if now.isEmpty():
            break
    best = found.groupBy("g").agg(F.expr("min_by(struct(mu, w), struct(logdet, start)) AS b")).selectExpr("g", "b.mu", "b.w")
    near = rows.join(near_by(best), "g").where(f"{_distance('mu', 'w')} <= {chi2_quantile(_NEAR, _P)}D").groupBy("g").agg(*_sums())
    fits = written(_solve(near.selectExpr("*", "0 AS start", unknown), str(_NEAR)))
    whole = fits.where(F.col("g") == _ALL).select("mu", "cov").first()  # one row of 27 numbers
    drawn_to = lambda c: f"CAST(array({', '.join(f'({c}[{i}] * n + {x!r}D * {prior_rows}) / (n + {prior_rows})' for i, x in enumerate(whole[c] if whole else []))}) AS array<double>) AS {c}"
    return written(fits.where(F.col("g") != _ALL).selectExpr("g AS group", drawn_to("mu"), drawn_to("cov")))


def squared_distances(x: np.ndarray, noise: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Mahalanobis distances, squared, of rows whose lower-triangle covariances get the rows' sampling variances."""
    whole = np.zeros((len(x), _P, _P))
    for at, (i, j) in enumerate(_PAIRS):
        whole[:, i, j] = whole[:, j, i] = cov[:, at]
    whole += np.eye(_P) * noise[:, None, :]
    off = x - mu
    return np.einsum("ij,ij->i", off, np.linalg.solve(whole, off[:, :, None])[:, :, 0])


def _near(x: np.ndarray, noise: np.ndarray, mu: pa.Array, cov: pa.Array, bound: float) -> np.ndarray:
    """Whether rows lie within the bound of their group's fit; rows of groups without one do."""
    fine = np.ones(len(x), bool)
    at = np.flatnonzero(mu.is_valid().to_numpy(zero_copy_only=False))
    if len(at):
        numbers = lambda a: a.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
        fine[at] = squared_distances(x[at], noise[at], numbers(mu), numbers(cov)) <= bound
    return fine


def _fits(found: DataFrame, groups: list[str]) -> DataFrame:
    """(__g, __mu, __cov) from the rows of ``found`` (as from ``measured``) that pass the base rules."""
    rows = found.where(~_failed()).select(_group(groups).alias("group"), *[F.col(c)[i].alias(f"{d}{i}") for c, d in (("__x", "x"), ("__v", "n")) for i in range(_P)])
    return estimate(rows).select(F.col("group").alias("__g"), F.col("mu").alias("__mu"), F.col("cov").alias("__cov"))


def judge(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), tail: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each input row.

    Null, empty and blank texts have no words and fail the base rules. A null language or source is
    a group of its own; a group of any size leans on all rows by as much as it is small. Equal
    vectors have equal verdicts in a group and count once in its estimate; repeated rows come back
    as often as they come. An empty table gives an empty result. Extra columns are ignored.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)])
    found = written(measured(source))
    names = [f"g{i}" for i in range(len(groups))]
    joined = found.withColumn("__g", _group(names)).join(small(_fits(found, names), _FEW), "__g", "left")
    bound = chi2_quantile(1 - tail, _P)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, v = (b.column(i).flatten().to_numpy().reshape(-1, _P) for i in (-4, -3))
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(_near(x, v, b.column(-2), b.column(-1), bound))], [*b.schema.names[:-4], "near"])

    kinds = dict(found.dtypes)
    rows = joined.select("doc_id", *[F.col("__s")[c].alias(c) for c in BASE], _failed().alias("base_failed"), "__x", "__v", "__mu", "__cov")
    out = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, near boolean")
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("near")).alias("kept"))


def accept(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), tail: float = 1e-6, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Estimates come from a first pass over the texts; a second pass measures again and filters, so
    that no text is shuffled while the groups' estimates fit a broadcast.
    """
    names = [f"g{i}" for i in range(len(groups))]
    parts = [F.col(text).alias("text"), *[F.col(g).alias(n) for g, n in zip(groups, names)]]
    fits = _fits(written(measured(docs.select(*parts))), names)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    joined = docs.select(row, *parts).withColumn("__g", _group(names)).join(small(fits, _FEW), "__g", "left").select("__row", "text", "__mu", "__cov")
    bound = chi2_quantile(1 - tail, _P)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _counted(b.column(1))
            keep = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
            keep &= _near(*vectors(counts), b.column(2), b.column(3), bound)
            yield b.select([0]).filter(pa.array(keep))

    return joined.mapInArrow(run, StructType([StructField("__row", docs.schema)])).select("__row.*")
