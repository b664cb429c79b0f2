"""SQL fragments shared by the oracle queries."""

from ..functions.seq import LETTER_BASES, LETTERS

K = 21

SEQ = rf"regexp_replace(translate(regexp_replace(text, '[\s.,]', '', 'g'), '{LETTERS}', '{LETTER_BASES}'), '[^ACGT]', 'N', 'g')"


def rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


def turned(x: str) -> str:
    return f"(translate({x}, 'ACGT', 'TGCA') < reverse({x}))"


def canon(x: str) -> str:
    return f"CASE WHEN {turned(x)} THEN {rc(x)} ELSE {x} END"


def seqs(table: str, key: str, name: str = "s") -> str:
    return f"{name} AS (SELECT {key}, {SEQ} AS seq FROM {table})"


def kmers(key: str, k: int = K, source: str = "s", name: str = "km") -> str:
    return f"""{name} AS (SELECT {key}, i AS pos, substr(seq, i + 1, {k}) AS kmer, seq FROM
      (SELECT {key}, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM {source} WHERE length(seq) >= {k}) w
      WHERE NOT regexp_matches(substr(seq, i + 1, {k}), '[^ACGT]'))"""


def bits(base: str, a: int, c: int, g: int, t: int) -> str:
    return f"CASE {base} WHEN 'A' THEN {a} WHEN 'C' THEN {c} WHEN 'G' THEN {g} WHEN 'T' THEN {t} ELSE 0 END"


def reversed_byte(x: str) -> str:
    return "(" + " + ".join(f"((({x}) >> {i}) & 1) * {1 << (7 - i)}" for i in range(8)) + ")"


def overlaps(key: str, k: int = K, source: str = "s", name: str = "ov") -> str:
    """canon, n, bf of all valid k-mers; both helper CTEs included."""
    left = bits("l", 128, 64, 32, 16)
    right = bits("r", 8, 4, 2, 1)
    return f"""{kmers(key, k, source, name + "_km")},
    {name}_nb AS (SELECT kmer, CASE WHEN pos > 0 THEN substr(seq, pos, 1) ELSE '' END AS l, substr(seq, pos + {k} + 1, 1) AS r FROM {name}_km),
    {name}_mk AS (SELECT kmer, ({left}) + ({right}) AS mask FROM {name}_nb),
    {name} AS (SELECT {canon("kmer")} AS canon, count(*) AS n, bit_or(CASE WHEN {turned("kmer")} THEN {reversed_byte("mask")} ELSE mask END) AS bf FROM {name}_mk GROUP BY 1)"""


def signed(k: int = K, source: str = "ov", name: str = "sg") -> str:
    return f"""{name} AS (SELECT canon AS kmer, bf, n FROM {source} UNION ALL SELECT {rc("canon")}, {reversed_byte("bf")}, n FROM {source})"""


def links(k: int = K, source: str = "sg", name: str = "lk") -> str:
    return f"""{name} AS (SELECT a.kmer, b.kmer AS next FROM
      (SELECT kmer, substr(kmer, 2) || CASE bf & 15 WHEN 8 THEN 'A' WHEN 4 THEN 'C' WHEN 2 THEN 'G' WHEN 1 THEN 'T' END AS next FROM {source} WHERE (bf & 15) IN (1, 2, 4, 8)) a
      JOIN {source} b ON a.next = b.kmer AND (b.bf & 240) IN (16, 32, 64, 128) WHERE a.next <> a.kmer AND a.next <> {rc("a.kmer")})"""


def unitigs(k: int = K, name: str = "un") -> str:
    """node_id, seq, kmer_cov from sg and lk; needs WITH RECURSIVE; data without pure cycles."""
    return f"""walk AS (
      SELECT kmer AS head, kmer AS cur, 0 AS step, n FROM sg WHERE kmer NOT IN (SELECT next FROM lk)
      UNION ALL SELECT w.head, l.next, w.step + 1, g.n FROM walk w JOIN lk l ON w.cur = l.kmer JOIN sg g ON g.kmer = l.next),
    spelled AS (SELECT head, head || coalesce(string_agg(substr(cur, {k}, 1), '' ORDER BY step) FILTER (WHERE step > 0), '') AS seq, sum(n) AS kmer_cov FROM walk GROUP BY head),
    one AS (SELECT least(seq, {rc("seq")}) AS seq, max(kmer_cov)::BIGINT AS kmer_cov FROM spelled GROUP BY 1),
    {name} AS (SELECT row_number() OVER (ORDER BY seq)::INTEGER AS node_id, seq, kmer_cov FROM one)"""


def arcs(k: int = K, nodes: str = "un", name: str = "ar") -> str:
    return f"""sn AS (SELECT node_id AS node, seq FROM {nodes} UNION ALL SELECT -node_id, {rc("seq")} FROM {nodes}),
    {name} AS (SELECT a.node AS src, b.node AS dst, base, c.n AS cov FROM
      (SELECT node, right(seq, {k}) AS last FROM sn) a JOIN sg ON sg.kmer = a.last
      JOIN (VALUES ('A', 8), ('C', 4), ('G', 2), ('T', 1)) v(base, bit) ON (sg.bf & bit) <> 0
      JOIN sn b ON substr(b.seq, 1, {k}) = substr(a.last, 2) || base JOIN sg c ON c.kmer = substr(a.last, 2) || base)"""


def graph(table: str = "benchmark", key: str = "item_id", k: int = K) -> str:
    return ", ".join((seqs(table, key), overlaps(key, k), signed(k), links(k), unitigs(k), arcs(k)))


def diagonals(match: int = 1, mismatch: int = -1, gap: int = -3, band: int | None = None, free: bool = False) -> str:
    """dp: the alignment cells of pr (item_id, a, b, n, m) by anti-diagonals d, p1[i + 1] being cell (i, d - i); needs WITH RECURSIVE."""
    low = -(1 << 28)
    outside = "d + 1 - i < 0 OR d + 1 - i > m" + ("" if band is None else f" OR abs(2 * i - d - 1) > {band}")
    edge = "0" if free else f"(d + 1) * {gap}"
    equal = "substr(a, i, 1) = substr(b, d + 1 - i, 1) OR substr(a, i, 1) = 'N' OR substr(b, d + 1 - i, 1) = 'N'"
    cell = f"CASE WHEN {outside} THEN {low} WHEN i = 0 OR i = d + 1 THEN {edge} ELSE greatest(p1[i] + {gap}, p1[i + 1] + {gap}, p2[i] + CASE WHEN {equal} THEN {match} ELSE {mismatch} END) END"
    return f"""dp AS (SELECT item_id, 0 AS d, list_transform(range(0, n + 1), lambda i: (CASE WHEN i = 0 THEN 0 ELSE {low} END)::INTEGER) AS p1, list_transform(range(0, n + 1), lambda i: ({low})::INTEGER) AS p2 FROM pr
      UNION ALL SELECT dp.item_id, d + 1, list_transform(range(0, n + 1), lambda i: ({cell})::INTEGER), p1 FROM dp JOIN pr ON pr.item_id = dp.item_id WHERE d < n + m)"""


# node paths from the events table: each user's event types in order, as signed node numbers
NODE = "(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END)::INTEGER"
STEPS = f"st AS (SELECT user_id, {NODE} AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"
CHAINS = STEPS + ", ch AS (SELECT user_id, array_agg(node ORDER BY p) AS chain FROM st GROUP BY user_id)"
ARCS = "ea AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM st a JOIN st b ON a.user_id = b.user_id AND b.p = a.p + 1)"


def join_text(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def back(x: str) -> str:
    return f"list_transform(list_reverse({x}), lambda v: -v)"


def grams(orders, source: str = "ch") -> str:
    """gr: ord, chain, next_node on both strands."""
    both = f"bo AS (SELECT chain FROM {source} WHERE len(chain) >= 3 UNION ALL SELECT {back('chain')} FROM {source} WHERE len(chain) >= 3)"
    one = " UNION ALL ".join(f"SELECT {o} AS ord, chain[i:i + {o - 1}] AS chain, chain[i + {o}] AS next_node FROM (SELECT chain, unnest(range(1, len(chain) - {o} + 1)) AS i FROM bo WHERE len(chain) > {o}) x" for o in orders)
    return f"{both}, gr AS ({one})"
