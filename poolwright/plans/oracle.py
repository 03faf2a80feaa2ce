"""What the registered queries should return, in SQL that another engine runs on the same tables."""

from __future__ import annotations

from math import log

from .queries import EXPERIMENT, K, N, PASSES, ROUNDS, SEED

_SEED_ORDER = f"md5('{SEED}:' || id), id"

_POOL = """
pool AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
lab AS (SELECT * FROM pool WHERE id % 5 = 0),
unl AS (SELECT * FROM pool WHERE id % 5 <> 0)"""


def _means(source: str, key: str, name: str) -> str:
    return f"""
{name} AS (SELECT {key}, list(v ORDER BY d) AS mean FROM (
  SELECT {key}, d, avg(v) AS v FROM (SELECT {key}, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM {source})
  GROUP BY ALL) GROUP BY {key})"""


_MODEL = _POOL + "," + _means("(SELECT label AS cls, vec FROM lab)", "cls", "m")


def _prob(rows: str, key: str, model: str = "m") -> str:
    """z, e and p by row and class, and p as a list."""
    return f"""
z AS (SELECT {key}, cls, -(list_distance(vec, mean) ** 2) / CAST(0.1 AS DOUBLE) AS z FROM {rows}, {model}),
e AS (SELECT {key}, cls, exp(z - max(z) OVER (PARTITION BY {key})) AS e FROM z),
p AS (SELECT {key}, cls, e / sum(e) OVER (PARTITION BY {key}) AS p FROM e),
pl AS (SELECT {key}, list(p ORDER BY cls) AS p FROM p GROUP BY ALL)"""


_PROB = _MODEL + "," + _prob("unl", "id")
_PASSES = (
    _MODEL
    + f""",
thrown AS (
  SELECT id, pass_no, list(CASE WHEN substr(md5(concat_ws(':', '{SEED}', pass_no, id, d - 1)), 1, 1) < '8' THEN 0.0::DOUBLE
                                ELSE 2 * v END ORDER BY d) AS vec
  FROM (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM unl),
       (SELECT unnest(range({PASSES})) AS pass_no)
  GROUP BY ALL),"""
    + _prob("thrown", "id, pass_no")
)
_MEAN_PROB = _PASSES + """,
mp AS (SELECT id, cls, avg(p) AS p FROM p GROUP BY ALL),
mpl AS (SELECT id, list(p ORDER BY cls) AS p FROM mp GROUP BY ALL)"""

_ENTROPY = "list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))"
_SCORE = {
    "least_confidence": "list_max(p)",
    "margin_sampling": "list_reverse_sort(p)[1] - list_reverse_sort(p)[2]",
    "entropy_sampling": _ENTROPY,
}


def _least(ctes: str, source: str, score: str, places: int = 6, n: int = N) -> str:
    return f"""WITH {ctes} SELECT id, score FROM (SELECT id, round({score}, {places}) + 0.0::DOUBLE AS score FROM {source})
ORDER BY score, id LIMIT {n}"""


_START = _POOL + f""",
c0 AS (SELECT row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1 AS cid, vec FROM unl
       ORDER BY md5('{SEED}:' || id), id LIMIT {K})"""


def _assign(name: str, centroids: str, rows: str = "unl") -> str:
    return f"""
{name} AS (SELECT id, vec, cid, d2 FROM (
  SELECT r.id, r.vec, c.cid, list_distance(r.vec, c.vec) ** 2 AS d2,
         row_number() OVER (PARTITION BY r.id ORDER BY list_distance(r.vec, c.vec), c.cid) AS nth
  FROM {rows} r, {centroids} c) WHERE nth = 1)"""


_ASSIGNED = _START + "," + _assign("a", "c0")


def _lloyd(rounds: int) -> str:
    out = _START
    for i in range(rounds):
        out += "," + _assign(f"a{i}", f"c{i}") + "," + _means(f"a{i}", "cid", f"m{i}") + f""",
c{i + 1} AS (SELECT c.cid, coalesce(m.mean, c.vec) AS vec FROM c{i} c LEFT JOIN m{i} m USING (cid))"""
    return out


_LLOYD = _lloyd(ROUNDS)
_PREDICTED = _PROB + """,
called AS (SELECT id, arg_max(cls, (p, -cls)) AS predicted FROM p GROUP BY id),
pred AS (SELECT id, label, predicted FROM unl JOIN called USING (id))"""

_COUNTS = """
k AS (SELECT unnest(range(10))::INT AS cls),
s AS (SELECT cls, (SELECT count(*) FROM pred WHERE label = cls AND predicted = cls) AS hits,
             (SELECT count(*) FROM pred WHERE predicted = cls) AS called,
             (SELECT count(*) FROM pred WHERE label = cls) AS support FROM k),
f AS (SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re
      FROM s)"""


def _curve(rounds: int = ROUNDS, n: int = N, seed: int | None = None, places: int = 6) -> str:
    """The learning loop unrolled: state, model, predictions and choice of each round, by entropy or, with a seed, at random."""
    out = _POOL.replace("WHERE id % 5 = 0", "WHERE id % 5 = 0 AND id % 10 <> 1") + """,
test AS (SELECT * FROM pool WHERE id % 10 = 1), train AS (SELECT * FROM pool WHERE id % 10 <> 1),
l0 AS (SELECT id FROM pool WHERE id % 5 = 0)"""
    parts = []
    for r in range(rounds + 1):
        out += "," + _means(f"(SELECT label AS cls, vec FROM train WHERE id IN (SELECT id FROM l{r}))", "cls", f"m{r}")
        out += f""",
t{r} AS (SELECT id, label, arg_min(cls, (list_distance(vec, mean), cls)) AS predicted FROM test, m{r} GROUP BY id, label),
k{r} AS (SELECT DISTINCT label AS cls FROM t{r} UNION SELECT DISTINCT predicted FROM t{r}),
s{r} AS (SELECT cls, count(*) FILTER (WHERE label = cls AND predicted = cls) AS hits,
                count(*) FILTER (WHERE predicted = cls) AS called, count(*) FILTER (WHERE label = cls) AS support
         FROM k{r}, t{r} GROUP BY cls),
f{r} AS (SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS pr,
                CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM s{r}),
w{r} AS (SELECT sum(hits) / sum(support) AS acc, sum(support * pr) / sum(support) AS precision,
                sum(support * re) / sum(support) AS recall,
                sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / sum(support) AS f1 FROM f{r})"""
        for metric in ("acc", "precision", "recall", "f1"):
            parts.append(f"SELECT {r} AS round, '{metric}' AS metric, round({metric}, {places}) AS value FROM w{r}")
        if r < rounds:
            prob = _prob(f"(SELECT * FROM train WHERE id NOT IN (SELECT id FROM l{r}))", "id", f"m{r}")
            for name in ("z", "e", "p", "pl"):
                prob = prob.replace(f"\n{name} AS", f"\n{name}_{r} AS").replace(f"FROM {name})", f"FROM {name}_{r})")
                prob = prob.replace(f"FROM {name} GROUP", f"FROM {name}_{r} GROUP")
            if seed is not None:  # random sampling
                out += f""",
q{r} AS (SELECT id FROM train WHERE id NOT IN (SELECT id FROM l{r}) ORDER BY md5('{seed}:' || id), id LIMIT {n}),
l{r + 1} AS (SELECT id FROM l{r} UNION SELECT id FROM q{r})"""
                continue
            out += "," + prob + f""",
q{r} AS (SELECT id FROM pl_{r} ORDER BY round({_ENTROPY}, 6), id LIMIT {n}),
l{r + 1} AS (SELECT id FROM l{r} UNION SELECT id FROM q{r})"""
    return f"WITH {out} " + " UNION ALL ".join(parts)


_RUNS = """
runs AS (
  SELECT r_name AS strategy, seed, round, metric, ((r_regionkey * 7 + seed * 3 + round * 5 + shift) % 11)::DOUBLE / 11 AS value
  FROM region, (SELECT unnest([1, 2, 3]) AS seed), (SELECT unnest([0, 1, 2, 3]) AS round),
       (SELECT unnest(['acc', 'precision', 'recall', 'f1']) AS metric, unnest([0, 1, 2, 3]) AS shift)),
l AS (SELECT strategy, seed, metric, value FROM runs WHERE round = 3)"""

_TARGETS = _ASSIGNED + """,
s AS (SELECT cid % 2 AS parent, cid AS child, count(*) AS size FROM a GROUP BY ALL),
t AS (SELECT 0 AS parent, 37 AS target UNION ALL SELECT 1, 1000000),"""


def _allocate(source: str, targets: str, name: str, seed: int) -> str:
    """Each parent's target over its children: the greatest cut by trying all, then the rest in seeded order."""
    return f"""
{name}_fit AS (SELECT parent, max(x) AS cut FROM (
  SELECT parent, x, sum(least(x, size)) AS used, any_value(target) AS target
  FROM {source} JOIN {targets} USING (parent), (SELECT unnest(range(0, 3000)) AS x)
  WHERE x <= (SELECT max(size) FROM {source} o WHERE o.parent = {source}.parent) GROUP BY parent, x)
  WHERE used <= target GROUP BY parent),
{name}_part AS (SELECT parent, child, size, target, cut, least(cut, size) AS share, size > cut AS above,
    least(target, sum(size) OVER (PARTITION BY parent)) - sum(least(cut, size)) OVER (PARTITION BY parent) AS rest
  FROM {source} JOIN {targets} USING (parent) JOIN {name}_fit USING (parent)),
{name} AS (SELECT parent, child, (share + CASE WHEN above AND row_number() OVER (
    PARTITION BY parent ORDER BY above DESC, md5('{seed}:' || child), child) <= rest THEN 1 ELSE 0 END)::BIGINT AS target
  FROM {name}_part)"""


_SAMPLED = (
    _ASSIGNED
    + """,
top AS (SELECT 0 AS parent, cid % 2 AS child, count(*) AS size FROM a GROUP BY ALL), whole AS (SELECT 0 AS parent, 20 AS target),"""
    + _allocate("top", "whole", "g2", SEED)
    + """,
low AS (SELECT cid % 2 AS parent, cid AS child, count(*) AS size FROM a GROUP BY ALL),
g2t AS (SELECT child AS parent, target FROM g2),"""
    + _allocate("low", "g2t", "g1", SEED + 1)
)



def _farthest(n: int) -> str:
    """Farthest-first picks unrolled."""
    out = _POOL + """,
d0 AS (SELECT u.id, u.vec, min(list_distance(u.vec, l.vec)) ** 2 AS d2 FROM unl u, lab l GROUP BY ALL)"""
    for i in range(1, n + 1):
        out += f""",
p{i} AS MATERIALIZED (SELECT * FROM d{i - 1} ORDER BY round(d2, 6) DESC, id LIMIT 1),
d{i} AS MATERIALIZED (SELECT d.id, d.vec, least(d.d2, list_distance(d.vec, p.vec) ** 2) AS d2 FROM d{i - 1} d, p{i} p WHERE d.id <> p.id)"""
    picks = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, n + 1))
    return f"WITH {out} SELECT id, round(-sqrt(d2), 6) AS score FROM ({picks})"


#: The least squared distance to a class boundary. For scores linear in the vector the first step lands on it.
_BOUNDARY = _PREDICTED + """,
g AS (SELECT z.id, (z.z - y.z) ** 2 / ((list_distance(mc.mean, my.mean) * 2 / CAST(0.1 AS DOUBLE)) ** 2) AS s
      FROM z JOIN called c USING (id) JOIN z y ON y.id = z.id AND y.cls = c.predicted
      JOIN m mc ON mc.cls = z.cls JOIN m my ON my.cls = y.cls WHERE z.cls <> y.cls),
b AS (SELECT id, min(s) AS s FROM g GROUP BY id)"""

#: Steps of 0.05 by the gradient's sign while the class is the first one, at most 100. Scores are 2 (mean . x) / 0.1 less
#: mean . mean / 0.1; the gradient is the mean of the weights by probability less the predicted class's.
_BIM = f"""WITH RECURSIVE {_MODEL.strip()},
w AS MATERIALIZED (SELECT cls, list_transform(mean, lambda v: 20 * v) AS w, -10 * list_dot_product(mean, mean) AS o FROM m),
steps AS (
  SELECT 0 AS step, id, vec AS x, list_transform(vec, lambda v: 0.0::DOUBLE) AS eta,
         (SELECT arg_max(cls, (list_dot_product(u.vec, w.w) + w.o, -cls)) FROM w) AS first, true AS same
  FROM unl u
  UNION ALL
  SELECT step + 1, id, x,
         CASE WHEN now = first THEN list_transform(eta, lambda v, i: v + 0.05 * sign(gradient[i])) ELSE eta END, first, now = first
  FROM (
    SELECT step, id, x, eta, first, any_value(now) AS now,
           list(g ORDER BY d) AS gradient
    FROM (
      SELECT step, id, x, eta, first, now, d, sum(p * v) - any_value(v) FILTER (WHERE cls = now) AS g
      FROM (
        SELECT step, id, x, eta, first, cls, e / sum(e) OVER (PARTITION BY id) AS p,
               arg_max(cls, (z, -cls)) OVER (PARTITION BY id) AS now, unnest(w) AS v, generate_subscripts(w, 1) AS d
        FROM (
          SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e
          FROM (SELECT s.*, cls, w, list_dot_product(list_transform(x, lambda v, i: v + eta[i]), w) + o AS z
                FROM steps s, w WHERE same AND step < 100)))
      GROUP BY ALL)
    GROUP BY ALL))
SELECT id, score FROM (
  SELECT id, round(list_dot_product(arg_max(eta, step), arg_max(eta, step)), 6) AS score FROM steps GROUP BY id)
ORDER BY score, id LIMIT {N}"""


def _rounds(rows: str, rounds: int, name: str) -> str:
    """Lloyd's rounds from the centroids ``name``0 (cid, vec)."""
    out = ""
    for i in range(rounds):
        out += "," + _assign(f"{name}a{i}", f"{name}{i}", rows) + "," + _means(f"{name}a{i}", "cid", f"{name}m{i}") + f""",
{name}{i + 1} AS MATERIALIZED (SELECT c.cid, coalesce(m.mean, c.vec) AS vec FROM {name}{i} c LEFT JOIN {name}m{i} m USING (cid))"""
    return out


def _plus_plus(k: int, rounds: int) -> str:
    """Greedy k-means++ unrolled: rows of least -ln(u) / d2 are tried, the one that leaves the least potential stays."""
    out = _POOL + f""",
ch1 AS MATERIALIZED (SELECT 0 AS cid, vec FROM (SELECT * FROM unl ORDER BY md5('{SEED}:' || id), id LIMIT 1))"""
    for n in range(1, k):
        u = f"(('0x' || substr(md5('{SEED * 1000003 + n}:' || id), 1, 12))::BIGINT + 1) / 2.0::DOUBLE ** 48"
        out += f""",
at{n} AS MATERIALIZED (SELECT u.id, u.vec, min(list_distance(u.vec, c.vec)) ** 2 AS d2 FROM unl u, ch{n} c GROUP BY ALL),
try{n} AS MATERIALIZED (SELECT id, vec, row_number() OVER (ORDER BY -ln({u}) / d2, id) AS nth FROM at{n} WHERE d2 > 0
  ORDER BY nth LIMIT {2 + int(log(k))}),
left{n} AS (SELECT t.nth, t.vec, sum(least(a.d2, list_distance(a.vec, t.vec) ** 2)) AS potential FROM at{n} a, try{n} t GROUP BY ALL),
ch{n + 1} AS MATERIALIZED (SELECT * FROM ch{n} UNION ALL
  SELECT {n}, vec FROM (SELECT * FROM left{n} ORDER BY potential, nth LIMIT 1))"""
    out += f", k0 AS (SELECT * FROM ch{k})" + _rounds("unl", rounds, "k") + "," + _assign("a", f"k{rounds}")
    return f"WITH {out} SELECT cid, count(*) AS n FROM a GROUP BY cid"


def _parallel(k: int, rounds: int, passes: int = 5, oversampling: int = 2) -> str:
    """Whole samples by squared distance, unrolled; then weighted k-means++ over them, and rounds over all rows."""
    u = lambda n: f"(('0x' || substr(md5('{SEED * 1000003 + n}:' || id), 1, 12))::BIGINT + 1) / 2.0::DOUBLE ** 48"
    out = _POOL + f""",
c1 AS MATERIALIZED (SELECT id, vec FROM unl ORDER BY md5('{SEED}:' || id), id LIMIT 1)"""
    for n in range(1, passes + 1):
        out += f""",
far{n} AS MATERIALIZED (SELECT u.id, u.vec, min(list_distance(u.vec, c.vec)) ** 2 AS d2 FROM unl u, c{n} c GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT * FROM c{n} UNION SELECT id, vec FROM far{n} WHERE {u(n)} < {oversampling * k} * d2 / (SELECT sum(d2) FROM far{n}))"""
    out += f""",
w AS MATERIALIZED (
  SELECT c.id, c.vec, count(near.id) AS w FROM c{passes + 1} c
  LEFT JOIN (SELECT u.id, arg_min(c.id, (round(list_distance(u.vec, c.vec), 9), c.id)) AS cand FROM unl u, c{passes + 1} c GROUP BY u.id) near ON near.cand = c.id GROUP BY ALL),
p1 AS MATERIALIZED (SELECT 0 AS cid, id, vec FROM (SELECT * FROM w ORDER BY w DESC, id LIMIT 1))"""
    for n in range(1, k):
        out += f""",
p{n + 1} AS MATERIALIZED (SELECT * FROM p{n} UNION ALL SELECT {n}, id, vec FROM (
  SELECT w.id, w.vec, w.w * min(list_distance(w.vec, p.vec)) ** 2 AS x FROM w, p{n} p GROUP BY w.id, w.vec, w.w
  HAVING x > 0 ORDER BY -ln({u(1000 + n).replace("|| id", "|| w.id")}) / x, w.id LIMIT 1))"""
    out += f", k0 AS (SELECT cid, vec FROM p{k})" + _rounds("unl", rounds, "k") + "," + _assign("a", f"k{rounds}")
    return f"WITH {out} SELECT cid, count(*) AS n FROM a GROUP BY cid"


def _hierarchy_first(low: int, high: int, rounds: int) -> str:
    """Clusters of rows, and of their centroids; both start from the first ones."""
    out = _POOL + f""",
low0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_SEED_ORDER}) - 1 AS cid, vec FROM unl ORDER BY {_SEED_ORDER} LIMIT {low})"""
    out += _rounds("unl", rounds, "low") + "," + _assign("bottom", f"low{rounds}")
    out += f""",
points AS (SELECT cid AS id, vec FROM low{rounds}), high0 AS (SELECT id AS cid, vec FROM points WHERE id < {high})"""
    out += _rounds("points", rounds, "high") + "," + _assign("top", f"high{rounds}", "points")
    return f"""WITH {out},
s AS (SELECT 1 AS level, cid, count(*) AS size FROM bottom GROUP BY cid
      UNION ALL SELECT 2, top.cid, count(*) FROM bottom JOIN top ON top.id = bottom.cid GROUP BY ALL)
SELECT level, cid, size, row_number() OVER (PARTITION BY level ORDER BY size DESC, cid) AS place FROM s"""


def _hierarchy_seeded(clusters: tuple[int, ...], sizes: tuple[int, ...], rounds: int, resamples: int) -> str:
    """Levels over rows and over centroids; each is clustered, then again over the nearest members of its clusters."""
    out, points = _POOL, "unl"
    for level, (k, size) in enumerate(zip(clusters, sizes, strict=True)):
        rows = points
        for i in range(resamples + 1):
            name = f"h{level}r{i}c"
            out += f""",
{name}0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_SEED_ORDER}) - 1 AS cid, vec FROM {rows} ORDER BY {_SEED_ORDER} LIMIT {k})"""
            out += _rounds(rows, rounds, name) + "," + _assign(f"h{level}r{i}", f"{name}{rounds}", points)
            rows = f"h{level}s{i}"
            out += f""",
{rows} AS MATERIALIZED (SELECT id, vec FROM (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY round(d2, 12), id) AS nth FROM h{level}r{i}) WHERE nth <= {size})"""
        points = f"h{level}p"
        out += f", {points} AS (SELECT cid AS id, vec FROM h{level}r{resamples}c{rounds})"
    return f"""WITH {out},
s AS (SELECT 1 AS level, cid, count(*) AS size FROM h0r{resamples} GROUP BY cid
      UNION ALL SELECT 2, top.cid, count(*) FROM h0r{resamples} b JOIN h1r{resamples} top ON top.id = b.cid GROUP BY ALL)
SELECT level, cid, size, row_number() OVER (PARTITION BY level ORDER BY size DESC, cid) AS place FROM s"""


def _experiment() -> str:
    runs = " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, {n} AS n_query, {seed} AS seed, metric, value FROM ({_curve(1, n, seed if name == 'RandomSampling' else None, 12)}) WHERE round = 1"
        for name, n, seed in EXPERIMENT
    )
    over = "concat_ws(',', " + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in ("seed", "n_query", "strategy")) + ")"
    return f"""WITH r AS ({runs})
SELECT {over} AS over, seed, n_query, strategy, metric, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) + 0.0::DOUBLE AS std,
       round(min(value), 6) AS least, round(max(value), 6) AS greatest
FROM r GROUP BY GROUPING SETS ((seed, n_query, strategy, metric), (n_query, strategy, metric), (seed, strategy, metric), (strategy, metric), (n_query, metric), (metric))"""


_DRAWS = f"""WITH {_POOL},
f AS (SELECT vec FROM unl ORDER BY {_SEED_ORDER} LIMIT 1),
w AS (SELECT u.id, list_distance(u.vec, f.vec) ** 2 AS w FROM unl u, f),
h AS (SELECT id, sum(w) OVER (ORDER BY id) AS high, sum(w) OVER (ORDER BY id) - w AS low FROM w WHERE w > 0),
d AS (SELECT k AS draw, ('0x' || substr(md5('{SEED}:' || k), 1, 12))::BIGINT / 2.0::DOUBLE ** 48 * (SELECT sum(w) FROM w) AS place FROM range(1000) t(k))
SELECT draw, id FROM d ASOF JOIN h ON d.place >= h.low"""

#: The congruential sequence in single precision, standardised.
_LCG = """WITH RECURSIVE shapes AS (SELECT unnest([13, 5, 17]) AS q, unnest([9, 27, 27]) AS p),
v AS (
  SELECT q, p, q * (p + 1) AS n, 0 AS pos, (q * (p + 1) + 1)::FLOAT AS x FROM shapes
  UNION ALL
  SELECT q, p, n, pos + 1, (((n + 2)::FLOAT * x)::FLOAT + (n + 3)::FLOAT)::FLOAT % (n * n)::FLOAT FROM v WHERE pos + 1 < n)
SELECT q, p, pos, round((x::DOUBLE - avg(x::DOUBLE) OVER w) / stddev_samp(x::DOUBLE) OVER w, 4) + 0.0::DOUBLE AS v
FROM v WINDOW w AS (PARTITION BY q, p)"""


ORACLE_SQL: dict[str, str] = {
    "pool_state_counts": f"""WITH {_POOL} SELECT (SELECT count(*) FROM lab) AS n_labeled, (SELECT count(*) FROM unl) AS n_unlabeled,
        (SELECT count(*) FROM pool) AS n_train, (SELECT count(*) FROM pool WHERE label = 0) AS n_test""",
    "labeled_split": f"WITH {_POOL} SELECT id, label FROM lab",
    "unlabeled_split": f"WITH {_POOL} SELECT id, label FROM unl",
    "pool_with_mask": f"WITH {_POOL} SELECT id, id % 5 = 0 AS is_labeled FROM pool",
    "initial_labels_seeded": f"WITH {_POOL} SELECT id, 0 AS round FROM pool ORDER BY {_SEED_ORDER} LIMIT 100",
    "label_update_union": f"WITH {_POOL} SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS round FROM pool WHERE id % 5 = 0 OR id % 3 = 0",
    "label_update_negatives": f"""WITH {_POOL} SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS round FROM pool
        WHERE (id % 5 = 0 OR id % 3 = 0) AND id % 2 <> 0""",
    "class_dictionary": "SELECT (row_number() OVER (ORDER BY name) - 1)::INT AS idx, name FROM (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL)",
    "feature_eviction": f"WITH {_POOL} SELECT id FROM unl WHERE id NOT IN (SELECT id FROM unl ORDER BY {_SEED_ORDER} LIMIT {N})",
    "pixel_normalization_whole": f"""WITH {_POOL} SELECT id, (d - 1)::INT AS pos, round((floor((v + 1) * 100) / 255
        - [0.485, 0.456, 0.406][(d - 1) % 3 + 1]::DOUBLE) / [0.229, 0.224, 0.225][(d - 1) % 3 + 1]::DOUBLE, 6) + 0.0::DOUBLE AS value
        FROM (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM pool)""",
    "class_prototypes": f"WITH {_MODEL} SELECT cls, (generate_subscripts(mean, 1) - 1)::INT AS dim, round(unnest(mean), 6) + 0.0::DOUBLE AS v FROM m",
    "predict_prob": f"WITH {_PROB} SELECT id, cls, round(p, 6) + 0.0::DOUBLE AS p FROM p",
    "predict_class": f"WITH {_PREDICTED} SELECT id, predicted FROM pred",
    "random_sampling": f"WITH {_POOL} SELECT id FROM unl ORDER BY {_SEED_ORDER} LIMIT {N}",
    "mc_dropout_split_prob": f"WITH {_PASSES} SELECT id, pass_no::INT AS pass_no, cls, round(p, 6) + 0.0::DOUBLE AS p FROM p",
    "mc_dropout_mean_prob": f"WITH {_MEAN_PROB} SELECT id, cls, round(p, 6) + 0.0::DOUBLE AS p FROM mp",
    "bald_dropout": _least(
        _MEAN_PROB + f""",
own AS (SELECT id, avg(-{_ENTROPY}) AS h2 FROM pl GROUP BY id), both_h AS (SELECT id, h2 + {_ENTROPY} AS s FROM own JOIN mpl USING (id))""",
        "both_h", "s",
    ),
    "pairwise_l2_whole": f"""WITH {_POOL} SELECT a.id, b.id AS other, round(list_distance(a.vec, b.vec) ** 2, 6) + 0.0::DOUBLE AS distance
        FROM pool a, pool b WHERE b.id % 20 = 0""",
    "pairwise_cosine_whole": f"""WITH {_POOL} SELECT a.id, b.id AS other, round(2 - 2 * list_dot_product(a.vec, b.vec), 6) + 0.0::DOUBLE AS distance
        FROM pool a, pool b WHERE b.id % 20 = 0""",
    "assign_clusters": f"WITH {_ASSIGNED} SELECT id, cid, round(d2, 6) + 0.0::DOUBLE AS d2 FROM a",
    "compute_centroids": f"WITH {_ASSIGNED},{_means('a', 'cid', 'mm')} SELECT cid, (generate_subscripts(mean, 1) - 1)::INT AS dim, round(unnest(mean), 6) + 0.0::DOUBLE AS v FROM mm",
    "sort_cluster_by_distance": f"""WITH {_ASSIGNED} SELECT cid, id, round(d2, 6) AS d2,
        row_number() OVER (PARTITION BY cid ORDER BY round(d2, 6), id) AS nth FROM a""",
    "cluster_members": f"WITH {_ASSIGNED} SELECT cid, id, (row_number() OVER (PARTITION BY cid ORDER BY id) - 1)::INT AS nth FROM a",
    "kmeans_potential": f"""WITH {_ASSIGNED},{_means('a', 'cid', 'mm')} SELECT cid, count(*) AS n,
        round(sum(list_distance(vec, mean) ** 2), 5) AS potential FROM a JOIN mm USING (cid) GROUP BY cid""",
    "kmeans_fixed_iters": f"WITH {_LLOYD},{_assign('a', f'c{ROUNDS}')} SELECT id, cid, round(d2, 5) + 0.0::DOUBLE AS d2 FROM a",
    "kmeans_sampling": f"""WITH {_LLOYD},{_assign('a', f'c{ROUNDS}')} SELECT id, round(d2, 5) AS score FROM (
        SELECT id, round(d2, 6) AS d2, row_number() OVER (PARTITION BY cid ORDER BY round(d2, 6), id) AS nth FROM a) WHERE nth = 1""",
    "feature_kmeans_sampling": f"""WITH {_LLOYD} SELECT id, round(min(d2), 5) AS score FROM (
        SELECT r.id, round(list_distance(r.vec, c.vec) ** 2, 6) AS d2,
               row_number() OVER (PARTITION BY c.cid ORDER BY round(list_distance(r.vec, c.vec) ** 2, 6), r.id) AS nth
        FROM unl r, c{ROUNDS} c) WHERE nth = 1 GROUP BY id""",
    "kcenter_greedy": f"""WITH {_POOL},
d0 AS (SELECT u.id, u.vec, min(list_distance(u.vec, l.vec)) ** 2 AS d2 FROM unl u, lab l GROUP BY ALL),
p1 AS (SELECT * FROM d0 ORDER BY round(d2, 6) DESC, id LIMIT 1),
d1 AS (SELECT d.id, d.vec, least(d.d2, list_distance(d.vec, p.vec) ** 2) AS d2 FROM d0 d, p1 p WHERE d.id <> p.id),
p2 AS (SELECT * FROM d1 ORDER BY round(d2, 6) DESC, id LIMIT 1),
d2 AS (SELECT d.id, d.vec, least(d.d2, list_distance(d.vec, p.vec) ** 2) AS d2 FROM d1 d, p2 p WHERE d.id <> p.id),
p3 AS (SELECT * FROM d2 ORDER BY round(d2, 6) DESC, id LIMIT 1)
SELECT id, round(-sqrt(d2), 6) AS score FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""",
    "deepfool_linear": f"""WITH {_BOUNDARY}
SELECT id, round(s, 10) AS score FROM b ORDER BY round(s, 10), id LIMIT {N}""",
    "hierarchy_flat_sizes": f"""WITH {_ASSIGNED}, s AS (SELECT 1 AS level, cid, count(*) AS size FROM a GROUP BY cid
        UNION ALL SELECT 2, cid % 2, count(*) FROM a GROUP BY ALL)
        SELECT level, cid, size, row_number() OVER (PARTITION BY level ORDER BY size DESC, cid) AS place FROM s""",
    "random_selection": f"""WITH {_ASSIGNED} SELECT cid, id FROM (SELECT cid, id,
        row_number() OVER (PARTITION BY cid ORDER BY {_SEED_ORDER}) AS nth FROM a) WHERE nth <= 3""",
    "closest_selection": f"""WITH {_ASSIGNED} SELECT cid, id FROM (SELECT cid, id,
        row_number() OVER (PARTITION BY cid ORDER BY round(d2, 6), id) AS nth FROM a) WHERE nth <= 3""",
    "subcluster_targets": f"WITH {_TARGETS}{_allocate('s', 't', 'g', SEED)} SELECT parent, child, target FROM g",
    "hierarchical_sampling": f"""WITH {_SAMPLED} SELECT id FROM (SELECT id, target,
        row_number() OVER (PARTITION BY cid ORDER BY round(d2, 6), id) AS nth FROM a JOIN g1 ON g1.child = a.cid) WHERE nth <= target""",
    "accuracy": f"WITH {_PREDICTED} SELECT round(avg((label = predicted)::INT), 6) AS acc FROM pred",
    "weighted_prf": f"""WITH {_PREDICTED},{_COUNTS} SELECT round(sum(hits) / sum(support), 6) AS acc,
        round(sum(support * pr) / sum(support), 6) AS precision, round(sum(support * re) / sum(support), 6) AS recall,
        round(sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / sum(support), 6) AS f1 FROM f""",
    "confusion_matrix": f"""WITH {_PREDICTED}, k AS (SELECT label AS c FROM pred UNION SELECT predicted FROM pred)
        SELECT a.c AS label, b.c AS predicted, count(pred.id) AS n FROM k a CROSS JOIN k b
        LEFT JOIN pred ON pred.label = a.c AND pred.predicted = b.c GROUP BY a.c, b.c""",
    "prediction_report": f"""WITH {_PREDICTED} SELECT id AS image_index, 'class' || label AS real_class,
        'class' || predicted AS predicted_class, (label = predicted)::INT AS correct, '' AS path FROM pred""",
    "active_learning_curve": _curve(),
    "report_last_round": f"WITH {_RUNS} SELECT strategy, seed, metric, round(value, 6) AS value FROM l",
    "report_mean_std": f"""WITH {_RUNS} SELECT strategy, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
        printf('%.4f (±%.4f)', avg(value), stddev_pop(value)) AS shown FROM l GROUP BY ALL""",
    "report_pivot": f"""WITH {_RUNS} SELECT strategy, seed, {", ".join(f"round(max(value) FILTER (WHERE metric = '{m}'), 6) AS {m}" for m in ("acc", "precision", "recall", "f1"))}
        FROM l GROUP BY ALL""",
    "report_curves": f"WITH {_RUNS} SELECT metric, strategy, round, round(avg(value), 6) AS mean FROM runs GROUP BY ALL",
    "index_export_whole": f"""WITH {_POOL} SELECT CASE WHEN id % 10 = 1 THEN 'test' ELSE 'train' END AS split, id,
        label AS class_name, 'vec/' || id AS path FROM pool""",
    "kcenter_greedy_whole": _farthest(N),
    "deepfool_iterative": f"""WITH {_BOUNDARY} SELECT id, round(s, 12) AS score FROM b ORDER BY round(s, 12), id LIMIT {N}""",
    "adversarial_bim": _BIM,
    "kmeans_plus_plus": _plus_plus(K, ROUNDS),
    "kmeans_resumed": _plus_plus(K, ROUNDS),
    "kmeans_parallel": _parallel(K, ROUNDS),
    "hierarchical_kmeans_first": _hierarchy_first(20, 5, 5),
    "hierarchical_kmeans_seeded": _hierarchy_seeded((12, 4), (5, 2), 3, 2),
    "weighted_draws": _DRAWS,
    "experiment_rolled_up": _experiment(),
    "feature_table_refreshed": """WITH n AS (SELECT count(*) FILTER (WHERE vec_id % 2 = 0) AS half, count(*) AS whole FROM embeddings WHERE vec_id % 5 <> 0)
SELECT 0 AS step, half AS extracted, half AS n_rows, half AS n_ids FROM n UNION ALL SELECT 1, whole - half, whole, whole FROM n
UNION ALL SELECT 2, 0, whole, whole FROM n""",
    "texture_lcg_weights": _LCG,
}
ORACLE_SQL["saved_scorer_predict_prob"] = ORACLE_SQL["predict_prob"]
for _name, _score in _SCORE.items():
    ORACLE_SQL[_name] = _least(_PROB, "pl", _score)
    ORACLE_SQL[f"{_name}_dropout"] = _least(_MEAN_PROB, "mpl", _score)
