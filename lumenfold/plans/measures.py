"""Queries over entropies, spectra, dimensions and the shape of palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import assign, frames, geometry
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import CURVES_SQL, PALETTE_SQL, PIXELS_SQL, palette, pixels, samples, table

P, PP = f"WITH {PIXELS_SQL}", f"WITH {PALETTE_SQL}"


@query("miller_madow", f"WITH {CURVES_SQL}, p AS (SELECT curve, n / sum(n) OVER (PARTITION BY curve) AS p, n FROM hist) SELECT curve, round(-sum(p * ln(p)), 8) AS plugin, round(-sum(p * ln(p)) + (count(*) - 1) / (2.0 * sum(n)), 8) AS corrected FROM p GROUP BY curve")
def miller_madow(spark, d):
    """Entropy of each curve in nats, and with the bias of its occupied levels taken off."""
    h = samples(spark, d).groupBy("curve", "level").agg(F.count("*").alias("n"))
    g = h.groupBy("curve").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("k"))
    plain = F.log("total") - F.col("s") / F.col("total")
    return g.select("curve", F.round(plain, 8).alias("plugin"), F.round(plain + (F.col("k") - 1) / (2.0 * F.col("total")), 8).alias("corrected"))


@query("ridged_rate", f"{PP}, q AS (SELECT frame, l / 65536.0::DOUBLE AS l, a / 65536.0::DOUBLE AS a, b / 65536.0::DOUBLE AS b FROM palette), c AS (SELECT frame, var_samp(l) AS xx, covar_samp(l, a) AS xy, covar_samp(l, b) AS xz, var_samp(a) AS yy, covar_samp(a, b) AS yz, var_samp(b) AS zz FROM q GROUP BY frame) SELECT frame, round(0.5 * log2(greatest(1, (1 + xx) * ((1 + yy) * (1 + zz) - yz * yz) - xy * (xy * (1 + zz) - yz * xz) + xz * (xy * yz - (1 + yy) * xz))), 8) AS bits FROM c")
def ridged_rate(spark, d):
    """Half the log of the determinant of a palette's sample covariance plus the unit ridge, by its invariants."""
    x = [F.col(c) / 65536.0 for c in "lab"]
    g = palette(spark, d).groupBy("frame").agg(*[F.coalesce(F.covar_samp(x[i], x[j]), F.lit(0.0)).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])
    c = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    e1 = c[0, 0] + c[1, 1] + c[2, 2]
    e2 = (e1 * e1 - sum(c[i, j] * c[i, j] for i in range(3) for j in range(3))) / 2
    e3 = c[0, 0] * (c[1, 1] * c[2, 2] - c[1, 2] * c[1, 2]) - c[0, 1] * (c[0, 1] * c[2, 2] - c[1, 2] * c[0, 2]) + c[0, 2] * (c[0, 1] * c[1, 2] - c[1, 1] * c[0, 2])
    return g.select("frame", F.round(0.5 * F.log2(F.greatest(1 + e1 + e2 + e3, F.lit(1.0))), 8).alias("bits"))


@query("entropy_report", f"{PP}, q AS (SELECT frame, l / 65536.0::DOUBLE AS l, a / 65536.0::DOUBLE AS a, b / 65536.0::DOUBLE AS b FROM palette), m AS (SELECT frame, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM q GROUP BY frame), s AS (SELECT sqrt(var_pop(l)) AS sl, sqrt(var_pop(a)) AS sa, sqrt(var_pop(b)) AS sb, var_pop(l) AS xx, covar_pop(l, a) AS xy, covar_pop(l, b) AS xz, var_pop(a) AS yy, covar_pop(a, b) AS yz, var_pop(b) AS zz FROM q), t AS (SELECT sqrt(var_pop(l) + var_pop(a) + var_pop(b)) AS st FROM m) SELECT round(sl / (sl + sa + sb + st), 8) AS wl, round(sa / (sl + sa + sb + st), 8) AS wa, round(sb / (sl + sa + sb + st), 8) AS wb, round(st / (sl + sa + sb + st), 8) AS wt, round(0.5 * ln(pow(2 * pi() * exp(1.0), 3) * (xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))), 6) AS entropy, round(pow(xx + yy + zz, 2) / (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 8) AS dimension FROM s, t")
def entropy_report(spark, d):
    """Shares of the spread of each axis and of time, Gaussian entropy and effective dimension of all palettes together."""
    q = palette(spark, d).select("frame", *[(F.col(c) / 65536.0).alias(c) for c in "lab"])
    time = q.groupBy("frame").agg(*[F.avg(c).alias(c) for c in "lab"]).agg(F.sqrt(sum(F.var_pop(c) for c in "lab")).alias("st"))
    pairs = [("l", "l", "xx"), ("l", "a", "xy"), ("l", "b", "xz"), ("a", "a", "yy"), ("a", "b", "yz"), ("b", "b", "zz")]
    s = q.agg(*[F.covar_pop(x, y).alias(n) for x, y, n in pairs]).crossJoin(time)  # one row each
    xx, xy, xz, yy, yz, zz = (F.col(n) for _, _, n in pairs)
    spread = [F.sqrt(xx), F.sqrt(yy), F.sqrt(zz), F.col("st")]
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    return s.select(
        *[F.round(v / sum(spread), 8).alias(n) for v, n in zip(spread, ("wl", "wa", "wb", "wt"))],
        F.round(0.5 * F.log(F.lit((2 * 3.141592653589793 * 2.718281828459045) ** 3) * det), 6).alias("entropy"),
        F.round((xx + yy + zz) * (xx + yy + zz) / (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 8).alias("dimension"),
    )


VECTORS = "v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT label, vec_id, x FROM v WHERE r % greatest(1, n // 1000) = 0), d AS (SELECT p.label, p.vec_id, array_distance_(p.x, q.x) AS d FROM s p JOIN s q ON p.label = q.label AND p.vec_id <> q.vec_id)".replace("array_distance_(p.x, q.x)", "list_distance(p.x, q.x)")


def _near(spark, d):
    return geometry.sorted_distances(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")


@query("likelihood_dimension", f"WITH {VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d) AS k FROM d), e AS (SELECT label, vec_id, max(d) FILTER (WHERE k = 10) AS edge FROM r GROUP BY ALL HAVING count(*) >= 10), t AS (SELECT label, vec_id, sum(ln(edge / d)) AS t FROM r JOIN e USING (label, vec_id) WHERE k < 10 AND d > 1e-12 GROUP BY ALL) SELECT label, round(avg(9 / t) FILTER (WHERE t > 0), 6) AS dimension FROM t GROUP BY label")
def likelihood_dimension(spark, d):
    e = geometry.likelihood_dimension(_near(spark, d), ["label"], 10)
    return e.select("label", F.round("dimension", 6).alias("dimension"))


@query("two_nn_dimension", f"WITH {VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d) AS k FROM d WHERE d > 0), e AS (SELECT label, vec_id, max(d) FILTER (WHERE k = 1) AS a, max(d) FILTER (WHERE k = 2) AS b FROM r GROUP BY ALL) SELECT label, round(count(*) / sum(ln(b / a)), 4) AS dimension FROM e GROUP BY label")
def two_nn_dimension(spark, d):
    """From the ratio of the two least distances of each point; equal vectors count once."""
    e = table(spark, d, "embeddings")
    return frames.two_nn_dimension(e, ["label"], "vec_id", "embedding").select("label", F.round("dimension", 4).alias("dimension"))


@query("correlation_dimension", f"WITH {VECTORS}, m AS (SELECT label, max(d) AS m FROM d GROUP BY label), c AS (SELECT d.label, k, m * pow(2.0, -0.5 * k) AS r, count(*) FILTER (WHERE d < m * pow(2.0, -0.5 * k)) / count(*)::DOUBLE AS c FROM d JOIN m USING (label), generate_series(1, 12) t(k) GROUP BY d.label, k, m) SELECT label, CASE WHEN count(*) >= 2 THEN round(regr_slope(ln(c), ln(r)), 5) END AS dimension FROM c WHERE c > 0.02 AND c < 0.8 GROUP BY label")
def correlation_dimension(spark, d):
    e = geometry.correlation_dimension(_near(spark, d), ["label"])
    return e.select("label", F.round("dimension", 5).alias("dimension"))


CORR = ", ".join(f"coalesce(corr(embedding[{i}]::DOUBLE, embedding[{j}]::DOUBLE), 0) AS c{i}_{j}" for i in range(1, 9) for j in range(1, i))


@query("participation_ratio", f"WITH c AS (SELECT label, {CORR}, {' + '.join(f'(stddev_pop(embedding[{i}]::DOUBLE) > 1e-9)::INT' for i in range(1, 9))} AS a FROM embeddings GROUP BY label) SELECT label, round(a * a / (a + 2 * ({' + '.join(f'c{i}_{j} * c{i}_{j}' for i in range(1, 9) for j in range(1, i))})), 6) AS ratio FROM c")
def participation_ratio(spark, d):
    return geometry.participation(table(spark, d, "embeddings"), ["label"], "embedding", 8).select("label", F.round("ratio", 6).alias("ratio"))


@query("mean_spacing", f"WITH {VECTORS}, m AS (SELECT label, vec_id, min(d) AS d FROM d GROUP BY ALL) SELECT label, round(avg(d), 6) AS spacing FROM m GROUP BY label")
def mean_spacing(spark, d):
    return geometry.mean_spacing(_near(spark, d), ["label"]).select("label", F.round("spacing", 6).alias("spacing"))


@query("spectral_entropy", f"{PP}, x AS (SELECT frame, slot, l / 65536.0::DOUBLE AS v, count(*) OVER (PARTITION BY frame) AS n FROM palette), w AS (SELECT frame, k, n, pow(sum(v * cos(-2 * pi() * k * slot / n)), 2) + pow(sum(v * sin(-2 * pi() * k * slot / n)), 2) AS p FROM x, generate_series(1, 15) t(k) WHERE k < n GROUP BY frame, k, n), t AS (SELECT *, sum(p) OVER (PARTITION BY frame) AS total FROM w) SELECT frame, round(-sum(p / total * ln(p / total)), 6) AS entropy, round(0.5 * ln(2 * pi() * exp(1.0)) + sum(ln(greatest(p, 1e-12))) / (2 * count(*)), 6) AS rate FROM t GROUP BY frame")
def spectral_entropy(spark, d):
    """Entropy and entropy rate of each palette's lightness over its slots."""
    curve = palette(spark, d).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "l"))), lambda s: s["l"] / 65536.0).alias("v"))
    p = curve.select("frame", geometry.dft_power(F.col("v")).alias("p"))
    return p.select("frame", F.round(geometry.spectral_entropy(F.col("p")), 6).alias("entropy"), F.round(geometry.entropy_rate(F.col("p")), 6).alias("rate"))


@query("covariance_eigen", f"{P}, q AS (SELECT frame, l / 65536.0::DOUBLE AS l, a / 65536.0::DOUBLE AS a, b / 65536.0::DOUBLE AS b FROM pixels), c AS (SELECT frame, var_pop(l) AS xx, covar_pop(l, a) AS xy, covar_pop(l, b) AS xz, var_pop(a) AS yy, covar_pop(a, b) AS yz, var_pop(b) AS zz FROM q GROUP BY frame), e AS (SELECT *, -(xx + yy + zz) AS p2, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS p1, -(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) AS p0 FROM c), d AS (SELECT frame, p2, (p2 * p2 - 3 * p1) AS dd, 2 * p2 * p2 * p2 - 9 * p2 * p1 + 27 * p0 AS qq FROM e), r AS (SELECT frame, p2, sqrt(dd) AS s, acos(least(1, greatest(-1, -qq / (2 * sqrt(dd * dd * dd))))) / 3 AS h FROM d) SELECT frame, round((-p2 + 2 * s * cos(h)) / 3, 8) AS e1, round((-p2 + 2 * s * cos(h - 2 * pi() / 3)) / 3, 8) AS e2, round((-p2 + 2 * s * cos(h + 2 * pi() / 3)) / 3, 8) AS e3, round((-p2 + 2 * s * cos(h)) / (-p2 + 2 * s * cos(h + 2 * pi() / 3)), 5) AS condition FROM r")
def covariance_eigen(spark, d):
    """Eigenvalues and condition number of each frame's colour covariance; the SQL solves the characteristic polynomial."""
    c = assign.covariance(pixels(spark, d).select("frame", *[(F.col(x) / 65536.0).alias(x) for x in "lab"]), ["frame"])
    e = geometry.eigenvalues3(*[F.col(f"c_{p}") for p in ("ll", "la", "lb", "aa", "ab", "bb")])
    return c.select("frame", *[F.round(v, 8).alias(f"e{i + 1}") for i, v in enumerate(e)], F.round(e[0] / e[2], 5).alias("condition"))


@query("carrier_checks")
def carrier_checks(spark, d):
    """CRC-32 and SHA-512 of every url; tests compare them with Python's."""
    return table(spark, d, "pages").select("page_id", F.crc32(F.coalesce("url", F.lit("")).cast("binary")).alias("crc"), F.sha2(F.coalesce("url", F.lit("")).cast("binary"), 512).alias("sha512"))
