"""SQL for the stand-in inputs and shared steps, in the dialect that the results are checked with."""

from larkspur import schemas

TURNS = """t AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS number, CAST(conv_id AS VARCHAR) || '-' || CAST(turn + 1 AS VARCHAR) AS sample_id,
  'topic ' || CAST(conv_id % 10 AS VARCHAR) AS title, text AS utt, text || ' (resolved)' AS oracle, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS resp,
  CASE WHEN turn % 4 = 3 THEN CAST([] AS BIGINT[]) ELSE [(conv_id + turn) % 7, (3 * conv_id + turn * turn) % 7] END AS prov FROM conversations),
ids AS (SELECT DISTINCT sample_id AS qid FROM t WHERE (conv_id + turn) % 3 <> 0)"""

FACTS = """f AS (SELECT number, CAST(i AS VARCHAR) AS idx, CASE WHEN i = 3 THEN '' WHEN i = 2 THEN 'it''s fact 2 of ' || number ELSE 'fact ' || CAST(i AS VARCHAR) || ' of ' || number END AS fact
  FROM (SELECT DISTINCT number FROM t), range(5) r(i))"""

ANSWERS = """a AS (SELECT *, conv_id * 1000 + turn AS line_no, CASE turn % 5 WHEN 0 THEN 'Response: ' || resp || chr(10) || ' Queries:  ' || utt WHEN 1 THEN 'Rewrite: ' || utt || chr(10) || 'Response: ' || resp
  WHEN 2 THEN 'Provenance: 1, 2' || chr(10) || 'Rewrite: ' || utt || chr(10) || 'Response: ' || resp || ' ' WHEN 3 THEN 'Provenance: 3 Rewrite: ' || utt || ' Response: ' || resp ELSE 'None of it: ' || utt END AS answer FROM t)"""

REWRITES = """w AS (SELECT *, CASE turn % 3 WHEN 0 THEN '1. ' || utt || '?' || chr(10) || '2. "' || utt || '"? more' WHEN 1 THEN utt || ', a, b, a,, c, d, e, f' ELSE utt END AS rewrite FROM t)"""

SELECTIONS = """s AS (SELECT *, CASE WHEN len(prov) = 0 THEN 'None' WHEN turn % 3 = 0 THEN '[' || CAST(prov[1] AS VARCHAR) || ', ' || CAST(prov[2] AS VARCHAR) || ']' WHEN turn % 3 = 1 THEN CAST(prov[1] AS VARCHAR) || ', ' || CAST(prov[2] AS VARCHAR) ELSE '$' || CAST(prov[1] AS VARCHAR) || ', $' || CAST(prov[2] AS VARCHAR) END AS chosen FROM t)"""

HISTORY = """h AS (SELECT sample_id, coalesce((SELECT string_agg('Question: ' || p.utt || chr(10) || 'Response: ' || p.resp || chr(10) || chr(10), '' ORDER BY p.turn) FROM t p WHERE p.conv_id = t.conv_id AND p.turn < t.turn), '') AS past FROM t)"""

LABELS = """l AS (SELECT t.sample_id, coalesce(nullif(string_agg(f.fact || chr(10), '' ORDER BY u.pos), ''), 'None') AS label FROM t LEFT JOIN (SELECT sample_id, unnest(prov) AS item, generate_subscripts(prov, 1) AS pos FROM t) u USING (sample_id)
  LEFT JOIN f ON f.number = t.number AND f.idx = CAST(u.item AS VARCHAR) AND f.fact <> '' GROUP BY t.sample_id)"""

DICTS = """x AS (SELECT number, '{' || string_agg('''' || idx || ''': ' || CASE WHEN contains(fact, '''') THEN '"' || fact || '"' ELSE '''' || fact || '''' END, ', ' ORDER BY idx) || '}' AS shown FROM f GROUP BY number)"""

JUDGED = """j AS (SELECT CAST(item_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS pid, (doc_id // 10 * 7 + item_id * 3) % 4 - 1 AS rel, CASE WHEN (doc_id // 10 * 7 + item_id * 3) % 4 - 1 >= 1 THEN 1 ELSE 0 END AS hit FROM documents JOIN benchmark ON doc_id % 10 = item_id % 10)"""

RUN = """r AS (SELECT CAST(item_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS pid, ((doc_id * 37 + item_id * 11) % 101) / 10.0::DOUBLE AS score, item_id * 10000000 + doc_id AS line_no FROM documents JOIN benchmark ON doc_id % 5 = item_id % 5)"""

BM25 = """toks AS (SELECT CAST(doc_id AS VARCHAR) AS pid, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents),
dls AS (SELECT CAST(doc_id AS VARCHAR) AS pid, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS dl FROM documents),
qt AS (SELECT CAST(item_id AS VARCHAR) AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT pid, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
sc AS (SELECT qid, pid, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.82 * (1 - 0.68 + 0.68 * dl / avgdl))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN dls USING (pid), st GROUP BY qid, pid),
bm AS (SELECT * FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc) WHERE rank <= 1000)"""

ALL_TERMS = """toks AS (SELECT CAST(doc_id AS VARCHAR) AS pid, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents),
dls AS (SELECT pid, count(*) AS dl FROM toks GROUP BY pid),
tf AS (SELECT pid, term, count(*) AS tf FROM toks GROUP BY ALL)"""


def metrics(run: str, keys: str = "qid") -> str:
    """CTE m: per-query metrics of the run named, by j."""
    on = ", ".join(f"k.{c.strip()}" for c in keys.split(","))
    sums = ", ".join([f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)::DOUBLE AS h{k}" for k in (5, 10, 20, 1000)] + [f"sum(CASE WHEN rank <= {k} THEN greatest(rel, 0) / log2(rank + 1) ELSE 0 END) AS d{k}" for k in (3, 5, 1000)])
    ideal = ", ".join(f"sum(CASE WHEN rank <= {k} THEN greatest(rel, 0) / log2(rank + 1) ELSE 0 END) AS i{k}" for k in (3, 5, 1000))
    shares = ", ".join([f"CASE WHEN rr > 0 THEN h{k} / rr ELSE 0 END AS recall_{k}" for k in (5, 10, 20, 1000)] + [f"CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0 END AS ndcg_cut_{k}" for k in (3, 5, 1000)])
    return f"""k0 AS (SELECT {", ".join("z." + c.strip() for c in keys.split(","))}, z.pid, row_number() OVER (PARTITION BY {", ".join("z." + c.strip() for c in keys.split(","))} ORDER BY CAST(z.score AS FLOAT) DESC, z.pid DESC) AS rank, coalesce(j.rel, 0) AS rel, coalesce(j.hit, 0) AS hit FROM {run} z LEFT JOIN j ON z.qid = j.qid AND z.pid = j.pid),
k AS (SELECT *, sum(hit) OVER (PARTITION BY {keys} ORDER BY rank) AS hits FROM k0),
e AS (SELECT {on}, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS ap, min(CASE WHEN hit = 1 THEN rank END) AS first, {sums} FROM k GROUP BY {on}),
b AS (SELECT qid, sum(hit) AS rr, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS rank FROM j) GROUP BY qid),
m AS (SELECT {", ".join("e." + c.strip() for c in keys.split(","))}, CASE WHEN rr > 0 THEN ap / rr ELSE 0 END AS map, coalesce(1.0 / first, 0) AS recip_rank, h20 / 20 AS P_20, {shares} FROM e JOIN b ON e.qid = b.qid)"""


_REPORT = dict(zip(schemas.METRICS, ("recip_rank", "ndcg_cut_3", "ndcg_cut_5", "ndcg_cut_1000", "P_20", "recall_20", "recall_1000", "map"), strict=True))


def reported(source: str = "m") -> str:
    return "SELECT " + ", ".join(f'round_even(avg({c}) * 100, 5) AS "{name}"' for name, c in _REPORT.items()) + f" FROM {source}"


def run_values() -> str:
    means = ", ".join(f'round_even(avg({c}) * 100, 5) AS "{name}"' for name, c in _REPORT.items())
    return f"""{JUDGED}, rr AS (SELECT CAST(item_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS pid, p.i AS position, r.i AS run, ((doc_id * (37 + 2 * p.i) + item_id * (11 + 3 * r.i)) % 101) / 10.0::DOUBLE AS score FROM documents JOIN benchmark ON doc_id % 25 = item_id % 25, range(4) p(i), range(5) r(i)),
{metrics("rr", "qid, position, run")},
v AS (SELECT position, 'method' || CAST(position AS VARCHAR) AS name, 'subset' || CAST(CAST(qid AS BIGINT) % 3 AS VARCHAR) AS subset, run, {means} FROM m GROUP BY ALL),
vl AS (UNPIVOT v ON {", ".join(f'"{name}"' for name in schemas.METRICS)} INTO NAME metric VALUE value)"""
