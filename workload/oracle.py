"""SQL counterparts of the registered queries, over the given tables.

Written from the definitions in long form (row x cell, winner x cell), not from
the way the library computes them.
"""

from __future__ import annotations

from latticemix.operators.external import INDEX_NAMES

from .queries import BITS, EPSILON, FIRST_N, FIT_ITER, K, MAX_ITER

TYPES = ("click", "error", "purchase", "signup", "view")
WIDTH = 64


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + "\n" + body


# -- shared pieces ---------------------------------------------------------------

_BITS = ", ".join(f"CAST(event_type = '{t}' AS INTEGER) AS b{j}" for j, t in enumerate(TYPES))
RAW = (
    "raw",
    f"SELECT event_id AS id, value AS v0, CAST(hour(ts) AS DOUBLE) AS v1, {_BITS} FROM events",
)
BOUNDS = ("bounds", "SELECT min(v0) lo0, max(v0) hi0, min(v1) lo1, max(v1) hi1 FROM raw")
PTS = (
    "pts",
    "SELECT id, (v0 - lo0) / nullif(hi0 - lo0, 0) AS x0, (v1 - lo1) / nullif(hi1 - lo1, 0) AS x1, "
    + ", ".join(f"b{j}" for j in range(BITS))
    + " FROM raw, bounds",
)
_K0 = ", ".join(f"CAST((c // {2 ** j}) % 2 AS INTEGER) AS p{j}" for j in range(BITS))
CELLS = (
    "cells0",
    f"""SELECT CAST(c AS INTEGER) AS cell, CAST(c // 5 AS INTEGER) AS r, CAST(c % 5 AS INTEGER) AS q,
    1.0::DOUBLE / {K} AS prob, 0.0::DOUBLE AS items,
    (c // 5)::DOUBLE / 5 + 1.0::DOUBLE / 10 AS m0, (c % 5)::DOUBLE / 5 + 1.0::DOUBLE / 10 AS m1,
    1.0::DOUBLE / {4 * K} AS v, {EPSILON}::DOUBLE AS eps, {_K0} FROM range({K}) t(c)""",
)
BASE = [RAW, BOUNDS, PTS, CELLS]


def temperature(t: int, max_iter: int) -> str:
    return f"(10.0::DOUBLE * pow(0.1::DOUBLE, {t}::DOUBLE / {max_iter - 1}))"


def hamming(p: str = "p", c: str = "c") -> str:
    return "(" + " + ".join(f"abs({p}.b{j} - {c}.p{j})" for j in range(BITS)) + ")::DOUBLE"


SQ = "((p.x0 - c.m0) * (p.x0 - c.m0) + (p.x1 - c.m1) * (p.x1 - c.m1))"
V = "greatest(c.v, 1e-12)"
LOG_GAUSS = f"(-0.5 * {SQ} / {V} - ln(2 * pi()) - ln({V}))"
EPS = "least(greatest(c.eps, 1e-30), 1 - 1e-16)"
LOG_BERN = f"({hamming()} * ln({EPS}) + ({BITS} - {hamming()}) * ln(1 - {EPS}))"
DENSITY = {"mixed": f"{LOG_GAUSS} + {LOG_BERN}", "cont": LOG_GAUSS, "bin": LOG_BERN}


def e_step(t: int, temp: str, components: str = "mixed") -> list[tuple[str, str]]:
    """CTEs nb, ld, top, lw, lpx, joint-free posteriors pc and pw of iteration t."""
    cells = f"cells{t - 1}"
    return [
        (
            f"nb{t}",
            f"""SELECT cs, c, w / sum(w) OVER (PARTITION BY cs) AS w FROM (
            SELECT a.cell AS cs, b.cell AS c, exp(-0.5 * (abs(a.r - b.r) + abs(a.q - b.q)) / {temp}) AS w
            FROM {cells} a, {cells} b)""",
        ),
        (f"ld{t}", f"SELECT p.id, c.cell, {DENSITY[components]} AS ld FROM pts p, {cells} c"),
        (f"top{t}", f"SELECT id, max(ld) AS top FROM ld{t} GROUP BY id"),
        (
            f"lw{t}",
            f"""SELECT l.id, n.cs, any_value(m.top) + ln(sum(n.w * exp(l.ld - m.top))) AS lw
            FROM ld{t} l JOIN top{t} m ON l.id = m.id JOIN nb{t} n ON n.c = l.cell GROUP BY l.id, n.cs""",
        ),
        (
            f"lpx{t}",
            f"""SELECT id, any_value(mx) + ln(sum(exp(a - mx))) AS lpx FROM (
            SELECT id, a, max(a) OVER (PARTITION BY id) AS mx FROM (
            SELECT w.id, w.lw + ln(c.prob) AS a FROM lw{t} w JOIN {cells} c ON c.cell = w.cs)) GROUP BY id""",
        ),
        (
            f"q{t}",
            f"SELECT n.c AS cell, ln(sum(n.w * c.prob)) AS lq FROM nb{t} n JOIN {cells} c ON c.cell = n.cs GROUP BY n.c",
        ),
        (
            f"pc{t}",
            f"""SELECT l.id, l.cell, l.ld + q.lq - x.lpx AS lp FROM ld{t} l JOIN q{t} q ON q.cell = l.cell
            JOIN lpx{t} x ON x.id = l.id""",
        ),
        (
            f"pw{t}",
            f"""SELECT w.id, w.cs, ln(c.prob) + w.lw - x.lpx AS lp FROM lw{t} w JOIN {cells} c ON c.cell = w.cs
            JOIN lpx{t} x ON x.id = w.id""",
        ),
    ]


def m_step(t: int, components: str = "mixed", move: bool = True) -> list[tuple[str, str]]:
    """CTEs mean, var, bits and the next cells."""
    cells = f"cells{t - 1}"
    sums = ", ".join(
        f"sum(exp(lp) * (1 - b{j})) AS z{j}, sum(exp(lp) * b{j}) AS o{j}" for j in range(BITS)
    )
    off = " + ".join(f"least(s.z{j}, s.o{j})" for j in range(BITS))
    moved = components != "bin" and move
    bits = components != "cont"
    new_bits = ", ".join(
        f"CASE WHEN s.z{j} >= s.o{j} THEN 0 ELSE 1 END AS p{j}" if bits else f"c.p{j}" for j in range(BITS)
    )
    return [
        (
            f"prior{t}",
            f"SELECT cs AS cell, avg(exp(lp)) AS prob FROM pw{t} GROUP BY cs",
        ),
        (
            f"items{t}",
            f"""SELECT cs AS cell, sum(CASE WHEN lp = mx THEN 1.0 ELSE 0.0 END)::DOUBLE AS items FROM (
            SELECT cs, lp, max(lp) OVER (PARTITION BY id) AS mx FROM pw{t}) GROUP BY cs""",
        ),
        (
            f"s{t}",
            f"""SELECT cell, sum(exp(lp)) AS n, sum(exp(lp) * x0) / sum(exp(lp)) AS m0,
            sum(exp(lp) * x1) / sum(exp(lp)) AS m1, {sums} FROM pc{t} JOIN pts USING (id) GROUP BY cell""",
        ),
        (
            f"var{t}",
            f"""SELECT a.cell, sum(exp(a.lp) * ((p.x0 - s.m0) * (p.x0 - s.m0) + (p.x1 - s.m1) * (p.x1 - s.m1)))
            / (2 * any_value(s.n)) AS v FROM pc{t} a JOIN pts p ON p.id = a.id JOIN s{t} s ON s.cell = a.cell GROUP BY a.cell""",
        ),
        (
            f"cells{t}",
            f"""SELECT c.cell, c.r, c.q, pr.prob, i.items,
            {'s.m0' if moved else 'c.m0'} AS m0, {'s.m1' if moved else 'c.m1'} AS m1,
            {'v.v' if moved else 'c.v'} AS v,
            {f'({off}) / ({BITS} * s.n)' if bits else 'c.eps'} AS eps, {new_bits}
            FROM {cells} c JOIN prior{t} pr ON pr.cell = c.cell JOIN items{t} i ON i.cell = c.cell
            JOIN s{t} s ON s.cell = c.cell JOIN var{t} v ON v.cell = c.cell""",
        ),
    ]


def chain(n: int, max_iter: int, components: str = "mixed", move: bool = True):
    out = list(BASE)
    for t in range(1, n + 1):
        out += e_step(t, temperature(t, max_iter), components) + m_step(t, components, move)
    return out


START = BASE + e_step(1, temperature(1, MAX_ITER))
STEP = chain(1, MAX_ITER)
BIN_MEAN = "concat(" + ", ".join(f"CAST(p{j} AS VARCHAR)" for j in range(BITS)) + ") AS bin_mean"
CELL_COLUMNS = ", ".join(
    ["cell", r6("prob", "prob"), r6("items", "num_items"), r6("m0", "m0"), r6("m1", "m1"),
     r6("v", "cont_variance"), BIN_MEAN, r6("eps", "bin_epsilon")]
)
FIT_TABLES = " UNION ALL ".join(f"SELECT {t}::INTEGER AS iteration, * FROM cells{t}" for t in range(FIT_ITER + 1))
STORED = chain(FIT_ITER, FIT_ITER)
FIRST_MAX = "SELECT id, {cell} AS cell, lp, row_number() OVER (PARTITION BY id ORDER BY lp DESC, {cell}) AS rn FROM {table}"

BUCKET = "CASE WHEN value < 25 THEN event_type ELSE CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) END"
LABELLED = ("lab", f"SELECT event_id AS id, event_type AS t, {BUCKET} AS p FROM events")
EVENT_CLUSTERS = [RAW, BOUNDS, PTS, ("buckets", f"SELECT event_id AS id, {BUCKET} AS label FROM events"),
                  ("ec", "SELECT id, label, x0, x1 FROM pts JOIN buckets USING (id)")]

# -- external indices -----------------------------------------------------------------

TABLE = ("tab", "SELECT t, p, count(*)::DOUBLE AS n FROM lab GROUP BY t, p")
MARGIN = [
    ("mt", "SELECT t, sum(n) AS a FROM tab GROUP BY t"),
    ("mp", "SELECT p, sum(n) AS b, max(n) AS top FROM tab GROUP BY p"),
    ("tot", "SELECT sum(n) AS n FROM tab"),
]
PAIRS = (
    "pr",
    """SELECT yy, yn, ny, n * (n - 1) / 2 - yy - yn - ny AS nn, n * (n - 1) / 2 AS nt FROM (
    SELECT yy, sa - yy AS yn, sb - yy AS ny, n FROM
    (SELECT sum(n * (n - 1)) / 2 AS yy FROM tab), (SELECT sum(a * (a - 1)) / 2 AS sa FROM mt),
    (SELECT sum(b * (b - 1)) / 2 AS sb FROM mp), tot)""",
)
EXTERNAL = [LABELLED, TABLE, *MARGIN, PAIRS]
INDEX_SQL = {
    "precision": "yy / nullif(yy + ny, 0)",
    "recall": "yy / nullif(yy + yn, 0)",
    "czekanowski_dice": "2 * yy / nullif(2 * yy + yn + ny, 0)",
    "rand": "(yy + nn) / nullif(nt, 0)",
    "rogers_tanimoto": "(yy + nn) / nullif(yy + 2 * (yn + ny) + nn, 0)",
    "fowlkes_mallows": "yy / nullif(sqrt((yy + yn) * (ny + yy)), 0)",
    "jaccard": "yy / nullif(yy + yn + ny, 0)",
    "kulczynski": "(yy / nullif(yy + ny, 0) + yy / nullif(yy + yn, 0)) / 2",
    "mcnemar": "(nn - ny) / nullif(sqrt(nn + ny), 0)",
    "russel_rao": "yy / nullif(nt, 0)",
    "sokal_sneath1": "yy / nullif(yy + 2 * (yn + ny), 0)",
    "sokal_sneath2": "(yy + nn) / nullif(yy + nn + (yn + ny) / 2, 0)",
    "purity": "(SELECT avg(top / b) FROM mp)",
    "nmi": """(SELECT -2 * (SELECT sum(tab.n * log10(tot.n * tab.n / (mt.a * mp.b))) FROM tab
        JOIN mt ON mt.t = tab.t JOIN mp ON mp.p = tab.p, tot)
        / nullif((SELECT sum(a * log10(a / tot.n)) FROM mt, tot) + (SELECT sum(b * log10(b / tot.n)) FROM mp, tot), 0))""",
    "hubert": """(nt * yy - (yy + yn) * (yy + ny))
        / nullif(sqrt(yy + yn) * sqrt(yy + ny) * sqrt(nn + yn) * sqrt(nn + ny), 0)""",
    "phi": "(yy * nn - yn * ny) / nullif((yy + yn) * (yy + ny) * (yn + nn) * (ny + nn), 0) * nt * nt",
}
REPORT = {
    "Czekanowski Dice": "czekanowski_dice", "Folkes Mallows": "fowlkes_mallows", "NMI": "nmi",
    "Precision": "precision", "Recall": "recall", "Rand": "rand",
}

# -- internal indices -----------------------------------------------------------------------

EMB = [
    ("emb", "SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings"),
    ("comp", f"SELECT e.id, e.label, j AS pos, e.x[j + 1] AS v FROM emb e, range({WIDTH}) t(j)"),
    ("ctr", "SELECT label, pos, avg(v) AS c FROM comp GROUP BY label, pos"),
    (
        "dist_ctr",
        "SELECT c.id, c.label, sqrt(sum((c.v - k.c) * (c.v - k.c))) AS d FROM comp c JOIN ctr k "
        "ON k.label = c.label AND k.pos = c.pos GROUP BY c.id, c.label",
    ),
    ("scat", "SELECT label, avg(d) AS s FROM dist_ctr GROUP BY label"),
    (
        "sim",
        """SELECT label, max((s1 + s2) / d) AS similarity FROM (
        SELECT a.label, any_value(sa.s) AS s1, any_value(sb.s) AS s2, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
        FROM ctr a JOIN ctr b ON a.pos = b.pos AND a.label <> b.label JOIN scat sa ON sa.label = a.label
        JOIN scat sb ON sb.label = b.label GROUP BY a.label, b.label) GROUP BY label""",
    ),
]


def silhouette_ctes(points: str, distance: str) -> list[tuple[str, str]]:
    """a, b and width per row of ``points`` (id, label, ...)."""
    return [
        ("sizes", f"SELECT label, count(*)::DOUBLE AS n FROM {points} GROUP BY label"),
        (
            "sums",
            f"""SELECT p.id, p.label, o.label AS other, sum({distance}) AS d
            FROM {points} p, {points} o WHERE p.id <> o.id GROUP BY p.id, p.label, o.label""",
        ),
        (
            "ab",
            """SELECT s.id, s.label, max(CASE WHEN s.label = s.other THEN s.d / (z.n - 1) END) AS a,
            min(CASE WHEN s.label <> s.other THEN s.d / z.n END) AS b
            FROM sums s JOIN sizes z ON z.label = s.other GROUP BY s.id, s.label""",
        ),
        (
            "wid",
            """SELECT label, coalesce(avg((b - a) / greatest(a, b)), 0) AS width FROM (
            SELECT z.label, ab.a, ab.b FROM sizes z LEFT JOIN ab ON ab.label = z.label
            AND a IS NOT NULL AND b IS NOT NULL) GROUP BY label""",
        ),
    ]


EMB_SIL = EMB[:1] + silhouette_ctes("emb", "list_distance(p.x, o.x)")
EVENT_SIL = EVENT_CLUSTERS + silhouette_ctes(
    "ec", "sqrt((p.x0 - o.x0) * (p.x0 - o.x0) + (p.x1 - o.x1) * (p.x1 - o.x1))"
)
EVENT_DB = EVENT_CLUSTERS + [
    ("ctr", "SELECT label, avg(x0) AS c0, avg(x1) AS c1 FROM ec GROUP BY label"),
    (
        "scat",
        """SELECT e.label, avg(sqrt((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1))) AS s,
        any_value(c0) AS c0, any_value(c1) AS c1 FROM ec e JOIN ctr USING (label) GROUP BY e.label""",
    ),
    (
        "sim",
        """SELECT a.label, max((a.s + b.s) / sqrt((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1)))
        AS similarity FROM scat a JOIN scat b ON a.label <> b.label GROUP BY a.label""",
    ),
]

# -- 64-dimensional model ----------------------------------------------------------------------

EMB_CELLS = (
    "ec0",
    """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cell, label FROM (SELECT DISTINCT label FROM emb)""",
)


def emb_iteration(t: int, temp: str) -> list[tuple[str, str]]:
    return [
        (
            f"enb{t}",
            f"""SELECT cs, c, w / sum(w) OVER (PARTITION BY cs) AS w FROM (
            SELECT a.cell AS cs, b.cell AS c,
            exp(-0.5 * (abs(a.cell // 5 - b.cell // 5) + abs(a.cell % 5 - b.cell % 5)) / {temp}) AS w
            FROM ec0 a, ec0 b)""",
        ),
        (
            f"eld{t}",
            f"""SELECT d.id, d.cell, -0.5 * d.sq / p.v - 32 * ln(2 * pi()) - 32 * ln(p.v) AS ld FROM (
            SELECT c.id, m.cell, sum((c.v - m.m) * (c.v - m.m)) AS sq FROM comp c JOIN em{t - 1} m ON m.pos = c.pos
            GROUP BY c.id, m.cell) d JOIN ep{t - 1} p ON p.cell = d.cell""",
        ),
        (f"eq{t}", f"SELECT n.c AS cell, ln(sum(n.w * p.prob)) AS lq FROM enb{t} n JOIN ep{t - 1} p ON p.cell = n.cs GROUP BY n.c"),
        (
            f"epc{t}",
            f"""SELECT id, cell, a - (mx + ln(sum(exp(a - mx)) OVER (PARTITION BY id))) AS lp FROM (
            SELECT id, cell, a, max(a) OVER (PARTITION BY id) AS mx FROM (
            SELECT l.id, l.cell, l.ld + q.lq AS a FROM eld{t} l JOIN eq{t} q USING (cell)))""",
        ),
        (
            f"epw{t}",
            f"""SELECT id, cs, a - (mx + ln(sum(exp(a - mx)) OVER (PARTITION BY id))) AS lp FROM (
            SELECT id, cs, a, max(a) OVER (PARTITION BY id) AS mx FROM (
            SELECT g.id, g.cs, g.top + ln(g.s) + ln(p.prob) AS a FROM (
            SELECT l.id, n.cs, any_value(l.top) AS top, sum(n.w * exp(l.ld - l.top)) AS s FROM (
            SELECT id, cell, ld, max(ld) OVER (PARTITION BY id) AS top FROM eld{t}) l
            JOIN enb{t} n ON n.c = l.cell GROUP BY l.id, n.cs) g JOIN ep{t - 1} p ON p.cell = g.cs))""",
        ),
        (
            f"em{t}",
            f"""SELECT a.cell, c.pos, sum(exp(a.lp) * c.v) / sum(exp(a.lp)) AS m FROM epc{t} a
            JOIN comp c ON c.id = a.id GROUP BY a.cell, c.pos""",
        ),
        (
            f"ep{t}",
            f"""SELECT v.cell, v.v, w.prob FROM (
            SELECT a.cell, sum(exp(a.lp) * (c.v - m.m) * (c.v - m.m)) / sum(exp(a.lp)) AS v FROM epc{t} a
            JOIN comp c ON c.id = a.id JOIN em{t} m ON m.cell = a.cell AND m.pos = c.pos GROUP BY a.cell) v
            JOIN (SELECT cs, avg(exp(lp)) AS prob FROM epw{t} GROUP BY cs) w ON w.cs = v.cell""",
        ),
    ]


EMB_MODEL = EMB[:3] + [
    EMB_CELLS,
    ("em0", "SELECT e.cell, c.pos, c.c AS m FROM ctr c JOIN ec0 e USING (label)"),
    ("ep0", "SELECT cell, 0.02::DOUBLE AS v, 0.1::DOUBLE AS prob FROM ec0"),
]
# Training labels: likelihood of the last start, prior it just computed.
EMB_FIT = (
    EMB_MODEL
    + [cte for t in range(1, FIT_ITER + 1) for cte in emb_iteration(t, temperature(t, FIT_ITER))]
    + [
        ("efq", f"SELECT n.c AS cell, ln(sum(n.w * p.prob)) AS lq FROM enb{FIT_ITER} n JOIN ep{FIT_ITER} p ON p.cell = n.cs GROUP BY n.c"),
        (
            "efl",
            f"""SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY a DESC, cell) AS rn FROM (
            SELECT l.id, l.cell, l.ld + q.lq AS a FROM eld{FIT_ITER} l JOIN efq q USING (cell))""",
        ),
    ]
)

# -- per query ------------------------------------------------------------------------------------


def long(value: str, table: str, cell: str = "cell") -> str:
    return f"SELECT id AS event_id, {cell}" + (" AS cell_star" if cell == "cs" else "") + f", {r6(value, 'value')} FROM {table}"


def per_cell(value: str, name: str = "value") -> str:
    return with_ctes(BASE, f"SELECT p.id AS event_id, c.cell, {r6(value, name)} FROM pts p, cells0 c")


def best(table: str, cell: str, ctes=START) -> str:
    inner = FIRST_MAX.format(cell=cell, table=table)
    return with_ctes(ctes, f"SELECT id AS event_id, cell FROM ({inner}) WHERE rn = 1")


HOME = (
    "home",
    "SELECT id, r, q, CAST(r * 5 + q AS INTEGER) AS cell FROM (SELECT id, CAST(least(floor(x0 * 5), 4) AS INTEGER) AS r, "
    "CAST(least(floor(x1 * 5), 4) AS INTEGER) AS q FROM pts)",
)
PREDICT = chain(FIT_ITER, FIT_ITER) + e_step(FIT_ITER + 1, temperature(FIT_ITER, FIT_ITER))
# The stored labels use the last likelihood with the prior it just computed.
LABELS_RUN = STORED + [
    (
        "qlab",
        f"SELECT n.c AS cell, ln(sum(n.w * c.prob)) AS lq FROM nb{FIT_ITER} n JOIN cells{FIT_ITER} c ON c.cell = n.cs GROUP BY n.c",
    ),
    (
        "plab",
        f"SELECT l.id, l.cell, l.ld + q.lq AS lp FROM ld{FIT_ITER} l JOIN qlab q ON q.cell = l.cell",
    ),
]
GRID = ", ".join(r6(f"max(CASE WHEN q = {c} THEN items END)", f"c{c}") for c in range(5))
QUALITY_NAMES = ("rand", "precision", "recall", "purity", "nmi")
QUALITY = START + [
    (
        "lab",
        "SELECT e.event_id AS id, e.event_type AS t, CAST(b.cell AS VARCHAR) AS p FROM events e JOIN ("
        + FIRST_MAX.format(cell="cell", table="pc1")
        + ") b ON b.id = e.event_id AND b.rn = 1",
    ),
    TABLE, *MARGIN, PAIRS,
]


# -- indices along a run ------------------------------------------------------------------

RUN_TABLES = [
    (
        "lab",
        " UNION ALL ".join(
            f"SELECT {t}::INTEGER AS it, id, cell AS p FROM ({FIRST_MAX.format(cell='cell', table=f'pc{t}')}) WHERE rn = 1"
            for t in range(1, FIT_ITER + 1)
        ),
    ),
    ("tab", "SELECT it, event_type AS t, p, count(*)::DOUBLE AS n FROM lab JOIN events ON event_id = id GROUP BY it, event_type, p"),
    ("mt", "SELECT it, t, sum(n) AS a FROM tab GROUP BY it, t"),
    ("mp", "SELECT it, p, sum(n) AS b, max(n) AS top FROM tab GROUP BY it, p"),
    ("tot", "SELECT it, sum(n) AS n FROM tab GROUP BY it"),
    (
        "pr",
        """SELECT it, yy, sa - yy AS yn, sb - yy AS ny, n * (n - 1) / 2 - sa - sb + yy AS nn, n * (n - 1) / 2 AS nt FROM
        (SELECT it, sum(n * (n - 1)) / 2 AS yy FROM tab GROUP BY it) JOIN
        (SELECT it, sum(a * (a - 1)) / 2 AS sa FROM mt GROUP BY it) USING (it) JOIN
        (SELECT it, sum(b * (b - 1)) / 2 AS sb FROM mp GROUP BY it) USING (it) JOIN tot USING (it)""",
    ),
    (
        "nm",
        """SELECT it, -2 * mutual / nullif(ha + hb, 0) AS nmi, purity FROM
        (SELECT tab.it, sum(tab.n * ln(tot.n * tab.n / (mt.a * mp.b))) AS mutual FROM tab JOIN mt ON mt.it = tab.it AND mt.t = tab.t
         JOIN mp ON mp.it = tab.it AND mp.p = tab.p JOIN tot ON tot.it = tab.it GROUP BY tab.it) JOIN
        (SELECT it, sum(a * ln(a / n)) AS ha FROM mt JOIN tot USING (it) GROUP BY it) USING (it) JOIN
        (SELECT it, sum(b * ln(b / n)) AS hb, avg(top / b) AS purity FROM mp JOIN tot USING (it) GROUP BY it) USING (it)""",
    ),
]
RUN_INDEX_SQL = {name: {"nmi": "nmi", "purity": "purity"}.get(name, INDEX_SQL[name]) for name in INDEX_NAMES}


def uniform(*counters: str) -> str:
    text = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in counters)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def all_oracles() -> dict[str, str]:
    out = {
        "read_delimited": "SELECT event_id, user_id, event_type, 3 AS n_tokens FROM events",
        "scan_continuous": "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(DISTINCT event_id) AS n_ids, "
        + r6("sum(value)", "sum_value") + " FROM events GROUP BY 1",
        "scan_binary": with_ctes([RAW], " UNION ALL ".join(
            f"SELECT {j}::INTEGER AS bit, sum(b{j})::BIGINT AS ones, count(*) AS n, count(*) - 1 AS last_id FROM raw"
            for j in range(BITS))),
        "scan_labels": "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1",
        "with_row_id": "SELECT count(*) AS n, count(*) AS n_ids, 0::BIGINT AS first_id, count(*) - 1 AS last_id, "
        + r6("sum(l_quantity)", "sum_quantity") + " FROM lineitem",
        "write_cells": with_ctes(STORED, f"SELECT iteration, {CELL_COLUMNS} FROM ({FIT_TABLES})"),
        "refused_run": with_ctes(STORED, f"SELECT iteration, {CELL_COLUMNS} FROM ({FIT_TABLES})"),
        "text_run": with_ctes(
            STORED,
            f"""SELECT iteration, cell, {r6('prob', 'prob')}, {r6('items', 'num_items')}, {r6('m0', 'm0')}, {r6('m1', 'm1')},
            {BIN_MEAN}, {r6('eps', 'bin_epsilon')}, {r6('sum(v) OVER (PARTITION BY iteration)', 'sum_variance')} FROM ({FIT_TABLES})""",
        ),
        "run_indices": with_ctes(
            STORED + RUN_TABLES,
            "SELECT it AS iteration, " + ", ".join(r6(e, n) for n, e in RUN_INDEX_SQL.items()) + " FROM pr JOIN nm USING (it)",
        ),
        "stored_evaluation": with_ctes(
            EXTERNAL,
            "SELECT " + ", ".join(r6(INDEX_SQL[n], n) for n in ("rand", "precision", "recall", "jaccard", "purity", "nmi")) + " FROM pr",
        ),
        "random_cells": f"""SELECT CAST(c AS INTEGER) AS cell, CAST(j AS INTEGER) AS pos,
            {r6(uniform('1', '0', 'c', 'j'), 'mean')}, CAST({uniform('1', '1', 'c', 'j')} >= 0.5 AS INTEGER) AS bit,
            {r6(uniform('1', '2', 'c', '0'), 'epsilon')}
            FROM range(10) a(c), (SELECT unnest(range(max(len(embedding)))) AS j FROM embeddings)""",
        "resumed_fit": with_ctes(STORED, f"SELECT iteration, {CELL_COLUMNS} FROM ({FIT_TABLES})"),
        "scan_ids": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, event_id, event_type FROM events",
        "job_labels": with_ctes(
            LABELS_RUN,
            "SELECT o.n AS id, b.cell FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) o JOIN ("
            + FIRST_MAX.format(cell="cell", table="plab") + ") b ON b.id = o.event_id AND b.rn = 1",
        ),
        "read_trajectory": with_ctes(STORED, f"SELECT iteration, r AS row, {GRID} FROM ({FIT_TABLES}) GROUP BY iteration, r"),
        "trajectory_sample": with_ctes(
            STORED, f"SELECT iteration, cell, {r6('eps', 'bin_epsilon')} FROM ({FIT_TABLES}) WHERE iteration % 2 = 0"
        ),
        "write_labels": with_ctes(
            LABELS_RUN,
            f"SELECT p.id AS event_id, {r6('p.x0', 'x0')}, {r6('p.x1', 'x1')}, b.cell FROM pts p JOIN ("
            + FIRST_MAX.format(cell="cell", table="plab") + ") b ON b.id = p.id AND b.rn = 1",
        ),
        "write_indices": with_ctes(
            EXTERNAL + EMB,
            " UNION ALL ".join(
                f"SELECT 'external' AS kind, '{name}' AS name, {r6(INDEX_SQL[col], 'value')} FROM pr"
                for name, col in REPORT.items()
            )
            + f" UNION ALL SELECT 'internal', 'Davies Bouldin', {r6('avg(similarity)', 'value')} FROM sim",
        ),
        "column_min_max": f"""SELECT 0::INTEGER AS pos, {r6('min(p_size)', 'lo')}, {r6('max(p_size)', 'hi')} FROM part
            UNION ALL SELECT 1, {r6('min(p_retailprice)', 'lo')}, {r6('max(p_retailprice)', 'hi')} FROM part""",
        "vector_width": """SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL) AS n_null,
            CAST(min(len(embedding)) AS INTEGER) AS narrowest, CAST(max(len(embedding)) AS INTEGER) AS widest FROM embeddings""",
        "minmax_normalize": with_ctes(BASE, f"SELECT id AS event_id, {r6('x0', 'x0')}, {r6('x1', 'x1')} FROM pts"),
        "first_n": with_ctes(
            BASE, f"SELECT id AS event_id, {r6('x0', 'x0')}, {r6('x1', 'x1')} FROM pts WHERE id < {FIRST_N}"
        ),
        "drop_leading": "SELECT p_partkey, array_to_string(string_split(p_type, ' ')[2:], '|') AS rest, "
        "CAST(len(string_split(p_type, ' ')) - 1 AS INTEGER) AS n FROM part",
        "concat_features": with_ctes(
            BASE,
            f"SELECT id AS event_id, 7 AS width, {r6('x0', 'x0')}, {r6('x1', 'x1')}, "
            + ", ".join(r6(f"b{j}", f"x{j + 2}") for j in range(BITS)) + " FROM pts",
        ),
        "join_features": with_ctes(
            BASE,
            f"SELECT id AS event_id, {r6('x0', 'x0')}, concat("
            + ", ".join(f"CAST(b{j} AS VARCHAR)" for j in range(BITS)) + ") AS bits FROM pts",
        ),
        "int_to_bits": "SELECT event_id, lpad(bin(user_id * 20), 20, '0') AS bits FROM events",
        "vector_arithmetic": with_ctes(
            BASE,
            "SELECT id AS event_id, " + ", ".join(
                r6(e.format(j=j), f"{n}{j}")
                for n, e in (("w", "x{j} * x0"), ("o", "(1 - x{j}) * x0"), ("t", "(x{j} * x0 + (1 - x{j}) * x0) / 2"))
                for j in range(2)
            ) + " FROM pts",
        ),
        "row_reductions": with_ctes(
            EMB[:2],
            f"""SELECT c.id AS vec_id, CAST(min(CASE WHEN v = mx THEN pos END) AS INTEGER) AS best,
            {r6('any_value(mx) + ln(sum(exp(v - mx)))', 'lse')}, {r6('sum(exp(v))', 'sum_exp')}
            FROM (SELECT *, max(v) OVER (PARTITION BY id) AS mx FROM comp) c GROUP BY c.id""",
        ),
        "init_cells": with_ctes(
            BASE + [HOME],
            f"""SELECT c.cell, c.r AS row, c.q AS col, {r6('c.prob', 'prob')}, {r6('c.items', 'num_items')},
            {r6('c.m0', 'm0')}, {r6('c.m1', 'm1')}, {r6('c.v', 'cont_variance')}, coalesce(h.n, 0) AS n_events
            FROM cells0 c LEFT JOIN (SELECT cell, count(*) AS n FROM home GROUP BY cell) h ON h.cell = c.cell""",
        ),
        "grid_distance": with_ctes(
            BASE + [HOME],
            f"""SELECT distance, count(*) AS n, {r6(f'sum(exp(-0.5 * distance / {temperature(1, MAX_ITER)}))', 'sum_kernel')}
            FROM (SELECT abs(r - 2) + abs(q - 2) AS distance FROM home) GROUP BY distance""",
        ),
        "neighborhood": with_ctes(
            START[:5] + [HOME],
            f"""SELECT n.c AS cell, {r6('sum(h.n * n.w)', 'spread')},
            sum(abs(n.c // 5 - n.cs // 5) + abs(n.c % 5 - n.cs % 5))::BIGINT AS distance
            FROM nb1 n JOIN (SELECT cell, count(*) AS n FROM home GROUP BY cell) h ON h.cell = n.cs GROUP BY n.c""",
        ),
        "annealing_schedule": f"""SELECT iteration, n, {r6('temp', 'temperature')}, {r6('n * temp', 'heat')} FROM (
            SELECT CAST(hour(ts) + 1 AS INTEGER) AS iteration, count(*) AS n,
            10 * pow(0.1::DOUBLE, (hour(ts) + 1)::DOUBLE / 23) AS temp FROM events GROUP BY hour(ts))""",
        "hamming_to_cells": per_cell(hamming(), "distance"),
        "log_gaussian_cells": per_cell(LOG_GAUSS),
        "log_gaussian_scaled": per_cell(f"(-ln(2 * pi() * sqrt(c.v)) - 0.5 * pow(sqrt({SQ}) / 2 / sqrt(c.v), 2))"),
        "gaussian_density": per_cell(f"exp(-{SQ} / (2 * c.v)) / (2 * pi() * sqrt(c.v))"),
        "log_bernoulli_cells": per_cell(LOG_BERN),
        "log_mixed_density": per_cell(DENSITY["mixed"]),
        "log_px_given_winner": with_ctes(START, long("lw", "lw1", "cs")),
        "log_px": with_ctes(START, f"SELECT id AS event_id, {r6('lpx', 'log_px')} FROM lpx1"),
        "joint_posterior": with_ctes(
            START,
            f"""SELECT cs AS cell_star, c AS cell, count(*) AS n, {r6('sum(exp(lp))', 'sum_p')},
            {r6('min(lp)', 'min_log_p')}, {r6('max(lp)', 'max_log_p')} FROM (
            SELECT n.cs, n.c, ln(n.w) + l.ld + ln(k.prob) - x.lpx AS lp FROM ld1 l JOIN nb1 n ON n.c = l.cell
            JOIN cells0 k ON k.cell = n.cs JOIN lpx1 x ON x.id = l.id) GROUP BY cs, c""",
        ),
        "posterior_winner": with_ctes(START, long("lp", "pw1", "cs")),
        "posterior_cell": with_ctes(START, long("lp", "pc1")),
        "assign_by_cell": best("pc1", "cell"),
        "assign_by_winner": best("pw1", "cs"),
        "log_likelihood": with_ctes(START, f"SELECT count(*) AS n, {r6('sum(lpx)', 'log_likelihood')} FROM lpx1"),
        "update_prior": with_ctes(STEP, f"SELECT cell, {r6('prob', 'prob')} FROM cells1"),
        "update_cont_mean": with_ctes(STEP, f"SELECT cell, {r6('m0', 'm0')}, {r6('m1', 'm1')} FROM cells1"),
        "update_cont_variance": with_ctes(STEP, f"SELECT cell, {r6('v', 'cont_variance')} FROM cells1"),
        "update_bin_prototype": with_ctes(STEP, f"SELECT cell, {BIN_MEAN} FROM cells1"),
        "update_bin_epsilon": with_ctes(STEP, f"SELECT cell, {r6('eps', 'bin_epsilon')} FROM cells1"),
        "items_per_cell": with_ctes(STEP, f"SELECT cell, {r6('items', 'num_items')} FROM cells1"),
        "em_step": with_ctes(STEP, f"SELECT {CELL_COLUMNS} FROM cells1"),
        "predict": best(f"pc{FIT_ITER + 1}", "cell", PREDICT),
        "fit_embeddings": with_ctes(
            EMB_FIT, "SELECT e.id AS vec_id, e.label, l.cell FROM emb e JOIN efl l ON l.id = e.id AND l.rn = 1"
        ),
        "posterior_embeddings": with_ctes(
            EMB_MODEL + emb_iteration(1, "1.0::DOUBLE"), f"SELECT id AS vec_id, cell, {r6('lp', 'value')} FROM epc1"
        ),
        "align_labels": with_ctes([LABELLED], "SELECT id AS event_id, t AS true_label, p AS pred_label FROM lab"),
        "alignment_report": """SELECT (SELECT count(*) FROM documents) AS n_true, (SELECT count(*) FROM labels) AS n_pred,
            (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS n_ids,
            (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_matched""",
        "points_with_labels": with_ctes(
            EVENT_CLUSTERS, f"SELECT id AS event_id, {r6('x0', 'x0')}, label FROM ec"
        ),
        "contingency": with_ctes([LABELLED], "SELECT t AS true_label, p AS pred_label, count(*) AS n FROM lab GROUP BY t, p"),
        "label_marginals": with_ctes(
            [LABELLED],
            "SELECT 'true' AS side, t AS label, count(*) AS n FROM lab GROUP BY t UNION ALL "
            "SELECT 'pred', p, count(*) FROM lab GROUP BY p",
        ),
        "pair_counts": with_ctes(EXTERNAL, "SELECT yy, yn, ny, nn, nt FROM pr"),
        "pair_notation": with_ctes(
            [LABELLED],
            """SELECT CASE WHEN a.t = b.t THEN 'y' ELSE 'n' END || CASE WHEN a.p = b.p THEN 'y' ELSE 'n' END AS notation,
            count(*) AS n FROM lab a JOIN lab b ON b.id = a.id + 1 GROUP BY 1""",
        ),
        "external_indices": with_ctes(
            EXTERNAL, "SELECT " + ", ".join(r6(INDEX_SQL[n], n) for n in INDEX_NAMES if n != "phi") + " FROM pr"
        ),
        "model_quality": with_ctes(QUALITY, "SELECT " + ", ".join(r6(INDEX_SQL[n], n) for n in QUALITY_NAMES) + " FROM pr"),
        "distinct_labels": f"SELECT DISTINCT {BUCKET} AS label FROM events",
        "cluster_sizes": f"SELECT {BUCKET} AS label, count(*) AS n FROM events GROUP BY 1",
        "cluster_centers": with_ctes(EMB[:3], f"SELECT label, CAST(pos AS INTEGER) AS pos, {r6('c', 'v')} FROM ctr"),
        "cluster_scatter": with_ctes(
            [("ctr", "SELECT p_brand AS label, avg(p_size::DOUBLE) AS c0, avg(p_retailprice) AS c1 FROM part GROUP BY 1")],
            f"""SELECT label, {r6('avg(sqrt(pow(p_size - c0, 2) + pow(p_retailprice - c1, 2)))', 'scatter')},
            {r6('any_value(c0)', 'c0')}, {r6('any_value(c1)', 'c1')} FROM part JOIN ctr ON label = p_brand GROUP BY label""",
        ),
        "distance_to_center": with_ctes(EMB[:4], f"SELECT id AS vec_id, {r6('d', 'distance')} FROM dist_ctr"),
        "cluster_similarity": with_ctes(EVENT_DB, f"SELECT label, {r6('similarity', 'similarity')} FROM sim"),
        "davies_bouldin": with_ctes(EVENT_DB, f"SELECT {r6('avg(similarity)', 'davies_bouldin')} FROM sim"),
        "within_cluster_distance": with_ctes(
            EMB_SIL, f"SELECT id AS vec_id, label, {r6('d', 'sum_dist')} FROM sums WHERE label = other"
        ),
        "silhouette_a": with_ctes(EMB_SIL, f"SELECT id AS vec_id, label, {r6('a', 'a')} FROM ab WHERE a IS NOT NULL"),
        "silhouette_b": with_ctes(EMB_SIL, f"SELECT id AS vec_id, label, {r6('b', 'b')} FROM ab WHERE b IS NOT NULL"),
        "silhouette_by_cluster": with_ctes(EMB_SIL, f"SELECT label, {r6('width', 'width')} FROM wid"),
        "silhouette": with_ctes(EMB_SIL, f"SELECT {r6('avg(width)', 'silhouette')} FROM wid"),
        "silhouette_events": with_ctes(EVENT_SIL, f"SELECT {r6('avg(width)', 'silhouette')} FROM wid"),
        "internal_indices": with_ctes(
            EMB + silhouette_ctes("emb", "list_distance(p.x, o.x)"),
            f"SELECT {r6('(SELECT avg(width) FROM wid)', 'silhouette')}, {r6('(SELECT avg(similarity) FROM sim)', 'davies_bouldin')}",
        ),
    }
    out["scan_whitespace"] = out["scan_continuous"]
    out["labels_sorted"] = with_ctes(
        START,
        "SELECT id AS event_id, CAST(cell AS VARCHAR) AS label FROM ("
        + FIRST_MAX.format(cell="cell", table="pc1") + ") WHERE rn = 1",
    )
    for name, (components, move) in {
        "fit_mixed": ("mixed", False), "fit_cont": ("cont", False), "fit_bin": ("bin", False),
        "fit_mixed_moving": ("mixed", True), "fit_cont_moving": ("cont", True),
    }.items():
        out[name] = with_ctes(
            chain(FIT_ITER, FIT_ITER, components, move), f"SELECT {CELL_COLUMNS} FROM cells{FIT_ITER}"
        )
    for name in INDEX_NAMES:
        out[name] = with_ctes(EXTERNAL, f"SELECT {r6(INDEX_SQL[name], name)} FROM pr")
    return out
