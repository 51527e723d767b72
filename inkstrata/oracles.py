"""The same results as ``queries`` in plain SQL for another engine, written from the rules and not from the Spark code.

Statements are chains of named parts; ``_with`` puts in the parts that a statement needs.
"""

from __future__ import annotations

import re

from . import fixtures


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "CAST([" + ", ".join(map(_literal, x)) + "] AS VARCHAR[])"
    return "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS v({names})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sents(x: str) -> str:
    return rf"""list_filter(string_split(regexp_replace({squeeze(x)}, '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"""


def plain(x: str) -> str:
    return squeeze(rf"regexp_replace({strip(f'lower({x})')}, '[^a-z0-9\s%]+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({plain(x)}, ' '), lambda t: t <> ''))"


def metric(x: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({x}, '(?i)[a-z0-9]+(?:\.[0-9]+)?%?|\$[0-9]+(?:\.[0-9]+)?[a-z]*'), lambda t: lower(t)))"


def search(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '(?i)[a-z0-9%]+'), lambda t: lower(t))"


def sha12(*x: str) -> str:
    return f"substr(sha1(concat_ws('|', {', '.join(x)})), 1, 12)"


def overlap(h: str, r: str, which: str) -> str:
    both = f"len(list_intersect({h}, {r}))"
    p, q = f"coalesce({both} / nullif(len({h}), 0), 0)", f"coalesce({both} / nullif(len({r}), 0), 0)"
    return {
        "precision": f"round({p}, 4)", "recall": f"round({q}, 4)", "f1": f"round(coalesce(2 * {p} * {q} / nullif({p} + {q}, 0), 0), 4)",
        "jaccard": f"round(coalesce({both} / nullif(len({h}) + len({r}) - {both}, 0), 0), 4)",
    }[which]


def hits(text: str, needles: str) -> str:
    return f"list_filter({needles}, lambda n: n <> '' AND contains(lower({text}), lower(n)))"


def rate(text: str, needles: str) -> str:
    return f"round(len({hits(text, needles)}) / nullif(len({needles}), 0), 4)"


REMARKS = r"'(?i)^(prepared\s+remarks|operator|management\s+remarks|opening\s+remarks)\b'"
QA = r"'(?i)^(question[-\s]?and[-\s]?answer|q\s*&\s*a|qa session|questions?\s+and\s+answers?)\b'"
FACT = (
    r"'(?i)(\d|%|basis\s+points|bps|revenue|eps|margin|guidance|grew|declined|increased|decreased|billion|million|percent|"
    r"year[- ]over[- ]year|quarter|outlook|customers?|subscribers?|arr|gmav)'"
)
FILLER = r"'(?i)^(thank you|thanks|good (morning|afternoon)|please go ahead|next question|operator|turn it over)\b'"


def no_speaker(x: str) -> str:
    return strip(rf"regexp_replace({x}, '(?i)^(analyst|operator|ceo|cfo|cto|coo|host|speaker)\s*[:\-]\s*', '')")


def split(x: str) -> str:
    unit = f"CAST(('0x' || substr(sha1({x} || '|sft-v0.1.0|94'), 1, 8)) AS UBIGINT) / 4294967295.0::DOUBLE"
    return f"CASE WHEN {unit} < 0.8::DOUBLE THEN 'train' WHEN {unit} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"


_DETECT = f"""CASE WHEN regexp_matches(first, {REMARKS}) THEN 'prepared_remarks' WHEN regexp_matches(first, {QA}) THEN 'qa'
 WHEN contains(lower(text), 'analyst:') OR contains(lower(text), 'q&a') OR contains(lower(text), 'question-and-answer') THEN 'qa' ELSE 'unknown' END"""

_LABEL = "CASE section WHEN 'prepared_remarks' THEN 'prepared remarks' WHEN 'qa' THEN 'Q&A' ELSE 'earnings-call' END"
_PAIR_COLUMNS = "pair_id, chunk_id, instruction, context, output, citations"

PARTS: dict[str, str] = {
    "docs": "SELECT doc_id, coalesce(text, '') AS text, source FROM documents",
    "asked": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "hand": _values(fixtures.TEXTS, "doc_id, source, text"),
    "recs": "SELECT doc_id AS pos, coalesce(nullif(source, ''), 'unknown') AS source_id, text FROM (SELECT doc_id, source, text FROM docs UNION ALL SELECT doc_id, source, text FROM hand)",
    "lines": rf"SELECT *, string_split_regex({strip('text')}, '[\n\r\x0b\x0c\x1c-\x1e]')[1] AS first, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]') AS ls FROM recs",
    "line": f"SELECT pos, source_id, {_DETECT} AS told, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines",
    "marked": f"""SELECT *, CASE WHEN length({strip('line')}) < 80 THEN CASE WHEN regexp_matches({strip('line')}, {REMARKS}) THEN 'prepared_remarks'
        WHEN regexp_matches({strip('line')}, {QA}) THEN 'qa' END END AS h FROM line""",
    "numbered": "SELECT *, sum(CASE WHEN h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY pos ORDER BY i) AS b FROM marked",
    "bodies": f"SELECT pos, source_id, b, coalesce(max(h), max(told)) AS section, {strip('''coalesce(string_agg(CASE WHEN h IS NULL THEN line END, chr(10) ORDER BY i), '')''')} AS body FROM numbered GROUP BY ALL",
    "sections": f"""SELECT pos, source_id, row_number() OVER (PARTITION BY pos ORDER BY b) - 1 AS block, section, body FROM bodies
        WHERE body <> '' AND pos IN (SELECT pos FROM marked WHERE h IS NOT NULL)
        UNION ALL SELECT pos, source_id, 0, {_DETECT}, text FROM lines WHERE pos NOT IN (SELECT pos FROM marked WHERE h IS NOT NULL)""",
    "cut": f"SELECT pos, source_id, block, section, {sents('body')} AS s FROM sections",
    "starts": "SELECT *, unnest(range(0, CAST(greatest(ceil((len(s) - 4) / 2), 0) * 2 + 1 AS BIGINT), 2)) AS st FROM cut WHERE len(s) > 0",
    "wins": f"SELECT pos, source_id, block, section, st, s[st + 1 : st + 4] AS own, {squeeze('''array_to_string(s[st + 1 : st + 4], ' ')''')} AS line FROM starts",
    "shaped": r"SELECT *, st + len(own) - 1 AS en, CASE WHEN length(line) > 1800 THEN regexp_replace(substr(line, 1, 1800), ' [^ ]*$', '') ELSE line END AS text FROM wins WHERE length(line) >= 40",
    "chunks": f"SELECT *, source_id || ':' || section || ':' || st || '-' || en || ':' || {sha12('source_id', 'section', 'st', 'en', 'text')} AS chunk_id FROM shaped",
    "said": "SELECT pos, block, st, chunk_id, unnest(own) AS sent, generate_subscripts(own, 1) - 1 AS i FROM chunks",
    "clean": f"SELECT *, {no_speaker('sent')} AS c FROM said",
    "rated": rf"""SELECT *, CASE WHEN regexp_matches(c, {FILLER}) OR length(c) < 20 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.15::DOUBLE + CASE WHEN regexp_matches(c, {FACT}) THEN 0.55::DOUBLE ELSE 0 END
        + CASE WHEN regexp_matches(c, '\d') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(c) BETWEEN 40 AND 280 THEN 0.15::DOUBLE WHEN length(c) > 400 THEN -0.2::DOUBLE ELSE 0 END) END AS sc FROM clean""",
    "props": r"""SELECT pos, block, st, chunk_id, i, round(sc, 3) AS score, CASE WHEN regexp_matches(c, '[.!?]$') THEN c ELSE regexp_replace(c, '[;,]+$', '') || '.' END AS text,
        row_number() OVER (PARTITION BY pos, block, st ORDER BY sc DESC, i) - 1 AS place FROM rated WHERE sc >= 0.45 QUALIFY row_number() OVER (PARTITION BY pos, block, st ORDER BY sc DESC, i) <= 8""",
    "folded": """SELECT pos, block, st, count(*) AS n, string_agg('- ' || text, chr(10) ORDER BY place) AS bullets, string_agg(chunk_id || '#s' || i, '; ' ORDER BY place) AS ids,
        list('[' || chunk_id || '#s' || i || '] ' || text ORDER BY place) AS cites FROM props GROUP BY pos, block, st""",
    "based": f"""SELECT c.pos, c.block, c.st, c.chunk_id, c.source_id, c.section, c.text, {_LABEL} AS label, coalesce(f.n, 0) AS n_props,
        coalesce(bullets, '- ' || substr(c.text, 1, 280)) AS bullets, coalesce(ids, c.chunk_id || '#s' || c.st) AS ids, coalesce(cites, ['[' || c.chunk_id || '] ' || substr(c.text, 1, 240)]) AS cites
        FROM chunks c LEFT JOIN folded f ON c.pos = f.pos AND c.block = f.block AND c.st = f.st""",
    "asks": """SELECT 0 AS k, 'qa' AS task, 'What did management report in this ' AS a, ' excerpt?' AS z UNION ALL SELECT 1, 'qa', 'Which quantitative results are stated in the ', ' passage?'
        UNION ALL SELECT 2, 'summary', 'Write a short research note grounded only in this ', ' excerpt.'""",
    "pairs": f"""SELECT *, chunk_id || ':' || task || ':' || {sha12('chunk_id', 'task', 'instruction')} AS pair_id,
        CASE task WHEN 'qa' THEN 'From the ' || label || ' excerpt, the supported facts are:' ELSE 'Research note from the ' || label || ' excerpt (grounded):' END || chr(10) || bullets || chr(10) || chr(10)
        || 'Citations: ' || ids || '. No figures beyond these source sentences.' AS output FROM (SELECT b.*, k, task, a || label || z AS instruction FROM based b, asks)""",
    "corpus": "SELECT * FROM based QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pos, block, st) = 1",
    "nexts": "SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "talks": """SELECT conv_id * 1000 + turn AS pos, 'c:' || conv_id || ':' || turn AS pair_id, '' AS chunk_id, 's' || (conv_id % 5) AS source_id, 'qa' AS task, text AS instruction, text AS context,
        t2 AS output, CAST([] AS VARCHAR[]) AS citations FROM nexts WHERE role = 'user' AND r2 = 'assistant'""",
    "hand_pairs": _values(fixtures.PAIRS, _PAIR_COLUMNS),
    "panel": _values(fixtures.PANEL, "id, context, must_cite, refuse, base_output, adapter_output"),
    # BM25.
    "dt": f"SELECT doc_id, {search('text')} AS ts FROM docs",
    "tf": "SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM dt) GROUP BY ALL",
    "dfs": "SELECT t, count(*) AS df FROM tf GROUP BY t",
    "st0": "SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dt",
    "qt": f"SELECT query_id, t, count(*) AS qtf FROM (SELECT query_id, unnest({search('query')}) AS t FROM asked) GROUP BY ALL",
    "bm": """SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * greatest(len(ts), 1) / avgdl))) AS score
        FROM qt JOIN tf USING (t) JOIN dfs USING (t) JOIN dt USING (doc_id), st0 GROUP BY ALL""",
    "bmall": "SELECT query_id, doc_id, coalesce(score, 0) AS score FROM asked CROSS JOIN (SELECT doc_id FROM docs) LEFT JOIN bm USING (query_id, doc_id)",
    "bmr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bmall QUALIFY rank <= 50",
    # Hashed embeddings.
    "ht": "SELECT doc_id, t, tf, sha256(t) AS h FROM tf",
    "hw": """SELECT doc_id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS UBIGINT) % 128 AS idx, sum(tf * CASE WHEN CAST(('0x' || h[9:10]) AS UBIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w
        FROM ht GROUP BY ALL HAVING w <> 0""",
    "hn": "SELECT doc_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM hw",
    "qh": "SELECT query_id, t, qtf, sha256(t) AS h FROM qt",
    "qw": """SELECT query_id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS UBIGINT) % 128 AS idx, sum(qtf * CASE WHEN CAST(('0x' || h[9:10]) AS UBIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w
        FROM qh GROUP BY ALL HAVING w <> 0""",
    "qn": "SELECT query_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qw",
    "dot": "SELECT query_id, doc_id, sum(qn.weight * hn.weight) AS score FROM qn JOIN hn USING (idx) GROUP BY ALL",
    "dotall": "SELECT query_id, doc_id, coalesce(score, 0) AS score FROM asked CROSS JOIN (SELECT doc_id FROM docs) LEFT JOIN dot USING (query_id, doc_id)",
    "dr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dotall QUALIFY rank <= 50",
    "fs": "SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM bmr UNION ALL SELECT query_id, doc_id, rank FROM dr) GROUP BY ALL",
    "fr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fs QUALIFY rank <= 10",
    "gold": "SELECT query_id, doc_id FROM asked JOIN docs ON contains(docs.text, query)",
    "lists": "SELECT 'bm25' AS backend, query_id, doc_id, rank FROM bmr WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dr WHERE rank <= 10 UNION ALL SELECT 'hybrid-rrf', query_id, doc_id, rank FROM fr",
    "ng": "SELECT query_id, count(*) AS n FROM gold GROUP BY 1",
    "per_query": """SELECT backend, query_id, k, coalesce(n, 0) AS n, (SELECT count(*) FROM lists l JOIN gold g USING (query_id, doc_id) WHERE l.backend = b.backend AND l.query_id = a.query_id AND rank <= k) AS hit,
        (SELECT coalesce(sum(1 / log2(rank + 1)), 0) FROM lists l JOIN gold g USING (query_id, doc_id) WHERE l.backend = b.backend AND l.query_id = a.query_id AND rank <= k) AS dcg,
        (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) x(r) WHERE r <= least(n, k)) AS ideal
        FROM asked a LEFT JOIN ng USING (query_id), (SELECT unnest([1, 3, 5, 10]) AS k), (SELECT unnest(['bm25', 'dense', 'hybrid-rrf']) AS backend) b""",
    # Packing: blocks in order, with what was used before.
    "blk": f"SELECT query_id, rank, '[' || doc_id || ' | ' || coalesce(source, '') || ']' || chr(10) || {strip('text')} AS block FROM bmr JOIN docs USING (doc_id) WHERE rank <= 5 AND {strip('text')} <> ''",
    "use": "SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM blk",
    "stop": "SELECT query_id, min(rank) AS ends FROM use WHERE used > 0 AND (used + 2 + length(block) > 3500 OR used >= 3500) GROUP BY 1",
    "pieces": """SELECT query_id, rank, CASE WHEN ends IS NULL OR rank < ends THEN block WHEN rank = ends AND used < 3500 AND 3500 - used - 2 > 40 THEN substr(block, 1, CAST(3500 - used - 2 AS BIGINT)) || '…' END AS piece
        FROM use LEFT JOIN stop USING (query_id)""",
    "packed": "SELECT query_id, count(*) AS n_blocks, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS packed FROM pieces WHERE piece IS NOT NULL GROUP BY 1",
    "prompts": """SELECT query_id, query, coalesce(packed, '') AS packed, 'Use only the retrieved excerpts below. Cite numbers that appear in them. If the excerpts do not contain the answer, say the information is not in the context.'
        || chr(10) || chr(10) || 'Excerpts:' || chr(10) || coalesce(packed, '') || chr(10) || chr(10) || 'Question:' || chr(10) || query AS prompt FROM asked LEFT JOIN packed USING (query_id)""",
    "answered": """SELECT query_id, 'base' AS side, packed, query, '[base dry-run] No weights loaded. Packed context is ' || length(packed) || ' chars. Run on Kaggle with --run (and optional --adapter-dir) to fill generations.' AS answer FROM prompts
        UNION ALL SELECT query_id, 'adapter', packed, query, substr(prompt, 200, 400) FROM prompts""",
}


def _generation(gold: str) -> dict[str, str]:
    """Scores of answers; gold is SQL for the gold answer, null if there is none."""
    return {
        "tok": f"SELECT query_id, side, answer, {gold} AS gold, {metric('answer')} AS ta, {metric('packed')} AS tc, {metric(f'''coalesce({gold}, '')''')} AS tg FROM answered",
        "need": """SELECT *, CASE WHEN coalesce(gold, '') = '' THEN list_filter(list_sort(tc), lambda t: length(t) >= 4)[1:8] WHEN len(list_intersect(tg, tc)) > 0 THEN list_sort(list_intersect(tg, tc))[1:12]
            ELSE list_sort(tg)[1:8] END AS needles FROM tok""",
        "four": f"SELECT query_id, side, coalesce(gold, '') <> '' AS has, {rate('answer', 'needles')} AS citation_rate, {overlap('ta', 'tc', 'f1')} AS f1_context, {overlap('ta', 'tg', 'f1')} AS g FROM need",
        "scored": """SELECT query_id, side, citation_rate, f1_context, CASE WHEN has THEN g END AS f1_gold,
            CASE WHEN (coalesce(citation_rate, 0) >= 0.5 AND f1_context >= 0.05) OR (has AND g >= 0.3 AND f1_context >= 0.1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grounded FROM four""",
    }


def _with(statement: str, more: dict[str, str] | None = None) -> str:
    parts = PARTS | (more or {})
    needed: list[str] = []
    open_: set[str] = set()  # a recursive part names itself

    def visit(sql: str) -> None:
        for name in parts:
            if name not in needed and name not in open_ and re.search(rf"(FROM|JOIN|,)\s*\(?{name}\b|\b(FROM|JOIN)\s+{name}\b", sql):
                open_.add(name)
                visit(parts[name])
                needed.append(name)

    visit(statement)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in needed) + "\n" + statement if needed else statement


def _heuristics() -> str:
    i, o, c = (strip(f"coalesce({x}, '')") for x in ("instruction", "output", "context"))
    n = "coalesce(citations, CAST([] AS VARCHAR[]))"
    tests = (
        (f"length({i}) < 12", "instruction_too_short"), (f"length({i}) > 600", "instruction_too_long"), (f"length({o}) < 40", "output_too_short"), (f"length({o}) > 4000", "output_too_long"),
        (f"length({c}) < 40", "context_too_short"), (f"{i} = '' OR {o} = ''", "empty_fields"), (f"len({n}) = 0", "missing_citation_list"),
        (rf"NOT (regexp_matches({o}, '(?i)\b(citation|citations|chunk_|source)\b') OR (chunk_id <> '' AND contains({o}, chunk_id)) OR len(list_filter({n}, lambda x: contains({o}, string_split(x, ']')[1]))) > 0)",
         "output_missing_citation_marker"),
    )
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{name}' END" for t, name in tests) + "], lambda x: x IS NOT NULL)"


def _judge() -> str:
    snippet = f"substr(lower({strip('''CASE WHEN contains(x, ']') THEN substr(x, strpos(x, ']') + 1) ELSE x END''')}), 1, 48)"
    cites = "coalesce(citations, CAST([] AS VARCHAR[]))"
    hit = f"len(list_filter({cites}, lambda x: ({snippet} <> '' AND contains(lower(coalesce(output, '')), {snippet})) OR (chunk_id <> '' AND contains(lower(coalesce(output, '')), lower(chunk_id)))))"
    return f"round(0.7::DOUBLE * least(1.0::DOUBLE, {hit} / greatest(len({cites}), 1)) + 0.3::DOUBLE * CASE WHEN length(coalesce(output, '')) BETWEEN 40 AND 2000 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END, 4)"

#: What the catalog must say, written out again.
_CATALOG = [
    ("earnings_transcripts", "S&P 500 earnings call transcripts", "primary grounding corpus (prepared remarks + Q&A)", "transcript,content,text", "MIT on the HF card; still public-company disclosures only.", 400,
     "kurry/sp500_earnings_transcripts", "https://huggingface.co/datasets/kurry/sp500_earnings_transcripts", "Large corpus. Always stream + cap with max_samples.", "train"),
    ("fiqa", "FiQA financial QA", "seed research-style question distribution", "question,answer,text", "Academic / task release; check the HF card before redistribution.", 200,
     "LLukas22/fiqa", "https://sites.google.com/view/fiqa/", "Question style prior; not grounded transcripts.", "train"),
    ("finance_alpaca", "Finance-Alpaca / Wealth-Alpaca", "instruction-style finance pairs (style prior only)", "instruction,input,output,text", "Derived Alpaca + FiQA mix; treat as public research sample.", 150,
     "gbharti/finance-alpaca", "https://huggingface.co/datasets/gbharti/finance-alpaca", "Style prior only; keep capped.", "train"),
]
_SAMPLE_TEXTS = [
    ("earnings_transcripts", "Thank you for joining Apple's first quarter fiscal 2024 results. We set an all-time revenue record of $119.6 billion, up 2 percent year over year, driven by iPhone and Services.", 4),
    ("earnings_transcripts", "Analyst: Can you talk about Azure growth excluding the impact of the extra calendar day? CEO: Azure grew 30 percent, and 28 percent constant currency, with AI services contributing several points.", 4),
    ("fiqa", "What does a beat versus a miss mean on an earnings call?\n\nA beat means reported EPS or revenue exceeded the consensus estimate; a miss means results came in below that estimate.", 3),
    ("finance_alpaca", "Explain prepared remarks versus the Q&A portion of an earnings call.\n\nPrepared remarks are a scripted management overview of results and outlook. Q&A is unscripted analyst questioning and is usually richer for research.", 4),
]
_BOTH_PAIRS = f"(SELECT {_PAIR_COLUMNS} FROM talks UNION ALL SELECT {_PAIR_COLUMNS} FROM hand_pairs)"
_ITEM = "SELECT query_id AS item_id, rank, doc_id, round(score, 6) AS score FROM {} WHERE rank <= 10"
_SIDES = "(SELECT id, 'base' AS side, context, must_cite, refuse, base_output AS output FROM panel UNION ALL SELECT id, 'adapter', context, must_cite, refuse, adapter_output FROM panel)"
_REFUSED = "(" + " OR ".join(
    f"contains(lower(coalesce({{0}}, '')), '{c}')" for c in (
        "not in the context", "not stated", "insufficient", "cannot determine", "does not say", "not provided", "no go-live", "will update", "refuse", "missing from the excerpt")
) + ")"
_PANEL = f"""SELECT id, side, {overlap(metric('output'), metric('context'), 'f1')} AS f1, {overlap(metric('output'), metric('context'), 'jaccard')} AS jaccard, {rate('output', 'must_cite')} AS citation_rate,
 {_REFUSED.format('output')} AS refused, CASE WHEN refuse THEN {_REFUSED.format('output')} END AS refusal_correct FROM {_SIDES}"""
_SEED = "'3407|'"


_EMBEDDING = """SELECT q_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM
            (SELECT q.vec_id AS q_id, e.vec_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""


def _jaccard_pairs(rows: str, threshold: float) -> str:
    """rows: SQL of (ord, block, ts)."""
    return f"""SELECT a.ord AS id_a, b.ord AS id_b, round(len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))), 6) AS jaccard FROM {rows} a JOIN {rows} b ON a.block = b.block AND a.ord < b.ord
 WHERE len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) >= {threshold}::DOUBLE"""


def _similar(a: str, b: str, threshold: float) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len({a}) + len({b}) - len(list_intersect({a}, {b})), 1) >= {threshold}::DOUBLE"


def _walk(parts: str, statement: str) -> str:
    """A scan in order: nodes (rn, forced) are kept unless an earlier neighbour (edges: rn, before) is kept."""
    return f"""WITH RECURSIVE nexts AS MATERIALIZED ({PARTS['nexts']}), talks AS MATERIALIZED ({PARTS['talks']}), {parts},
 walk(i, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT n.rn, CASE WHEN n.forced OR len(list_intersect(kept, coalesce(e.before, CAST([] AS BIGINT[])))) = 0 THEN list_append(kept, n.rn) ELSE kept END
 FROM walk w JOIN nodes n ON n.rn = w.i + 1 LEFT JOIN edges e ON e.rn = n.rn), done AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1) {statement}"""


def _dropped(nodes: str, edges: str) -> str:
    """Nodes that a scan in order drops. nodes: (rn, forced); edges: (a, rn) with a before rn. Only nodes with an earlier neighbour are walked:
    one is dropped if any of its earlier neighbours is not. Gives lists in a row each step; the last is the result."""
    return f"""SELECT 0::BIGINT AS i, CAST([] AS BIGINT[]) AS dropped UNION ALL
        SELECT i + 1, CASE WHEN len(list_filter(before, lambda a: NOT list_contains(dropped, a))) > 0 THEN list_append(dropped, rn) ELSE dropped END
        FROM {nodes}_walk w JOIN (SELECT rn, before, row_number() OVER (ORDER BY rn) AS step FROM (SELECT rn, list(a) AS before FROM {edges} WHERE rn NOT IN (SELECT rn FROM {nodes} WHERE forced) GROUP BY rn)) ON step = i + 1"""


def _dataset() -> str:
    """The flow from documents to split pairs. Blocks have fewer pairs than the 64 that a new one is compared with."""
    own = "CASE WHEN col = 's' THEN s ELSE t END"
    parts = {
        "recs": "SELECT doc_id AS pos, coalesce(nullif(source, ''), 'unknown') AS source_id, text FROM docs",
        "good": f"SELECT *, row_number() OVER (ORDER BY pos, block, st, k) AS rn FROM (SELECT *, text AS context, cites AS citations FROM pairs) WHERE len({_heuristics()}) = 0",
        "told": f"""SELECT rn, pair_id, source_id, task, instruction, output, sha1({plain("concat_ws('|', task, instruction, output)")}) AS fp, {tokens("concat_ws(' ', instruction, output)")} AS ts FROM good""",
        "dn": "SELECT *, false AS forced, concat_ws('|', source_id, task, length(output) // 80, array_to_string(list_sort(ts)[1:4], ' ')) AS bk FROM told",
        "de": f"""SELECT a.rn AS a, b.rn FROM dn a JOIN dn b ON a.fp = b.fp AND a.rn < b.rn UNION SELECT a.rn, b.rn FROM dn a JOIN dn b ON a.bk = b.bk AND a.rn < b.rn AND {_similar('a.ts', 'b.ts', 0.88)}""",
        "dn_walk": _dropped("dn", "de"),
        "once": "SELECT rn, pair_id, source_id AS s, task AS t, instruction, output FROM dn WHERE NOT list_contains((SELECT dropped FROM dn_walk ORDER BY i DESC LIMIT 1), rn)",
        "few": "SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY rn) <= 2000",
        # Cuts are found one after the other: the first pair that is too many for its source or task ends that one.
        "cutting": f"""SELECT 0 AS i, CAST([] AS STRUCT(col VARCHAR, name VARCHAR, stop BIGINT)[]) AS cuts UNION ALL
            SELECT i + 1, list_append(cuts, e) FROM (SELECT i, cuts, (SELECT arg_min({{'col': col, 'name': {own}, 'stop': rn}}, rn) FROM (
                SELECT col, s, t, rn, row_number() OVER (PARTITION BY col, {own} ORDER BY rn) AS n FROM few, (SELECT unnest(['s', 't']) AS col)
                WHERE len(list_filter(cuts, lambda x: x.stop <= rn AND ((x.col = 's' AND x.name = s) OR (x.col = 't' AND x.name = t)))) = 0)
                WHERE n = CASE col WHEN 's' THEN 2501 ELSE 4001 END) AS e FROM cutting) WHERE e IS NOT NULL""",
        "capped": "SELECT * FROM few WHERE len(list_filter((SELECT cuts FROM cutting ORDER BY i DESC LIMIT 1), lambda x: x.stop <= rn AND ((x.col = 's' AND x.name = s) OR (x.col = 't' AND x.name = t)))) = 0",
        "vn": f"""SELECT pair_id, s, t, row_number() OVER (ORDER BY s, t, pair_id) AS rn, row_number() OVER (PARTITION BY s, t ORDER BY pair_id) = 1 AS forced, {tokens("concat_ws(' ', t, instruction, output)")} AS ts FROM capped""",
        # Similar sets share one of their rarest tokens.
        "vt": "SELECT rn, len(ts) AS n, unnest(ts) AS w FROM vn",
        "vf": "SELECT w, count(*) AS df FROM vt GROUP BY w",
        "vp": "SELECT rn, n, w FROM vt JOIN vf USING (w) QUALIFY row_number() OVER (PARTITION BY rn ORDER BY df, w) <= n - ceil(0.72::DOUBLE * n - 1e-9) + 1",
        "vc": "SELECT DISTINCT x.rn AS a, y.rn FROM vp x JOIN vp y ON x.w = y.w AND x.rn < y.rn AND x.n >= 0.72::DOUBLE * y.n - 1e-9 AND y.n >= 0.72::DOUBLE * x.n - 1e-9",
        "ve": f"SELECT a, c.rn FROM vc c JOIN vn x ON x.rn = c.a JOIN vn y ON y.rn = c.rn WHERE {_similar('x.ts', 'y.ts', 0.72)}",
        "vn_walk": _dropped("vn", "ve"),
        "chosen": "SELECT pair_id, s, t FROM vn WHERE NOT list_contains((SELECT dropped FROM vn_walk ORDER BY i DESC LIMIT 1), rn) QUALIFY row_number() OVER (ORDER BY rn) <= 6000",
    }
    sql = _with(f"SELECT pair_id, s AS source_id, t AS task, {split('pair_id')} AS split FROM chosen", parts)
    for name in ("dn_walk", "cutting", "vn_walk"):
        sql = sql.replace(f"{name} AS MATERIALIZED (", f"{name} AS (")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def oracle_sql() -> dict[str, str]:
    o, i = metric("output"), metric("instruction")
    needles = f"list_append(list_sort({i})[1:5], '')"
    chat = f"'<|system|>' || chr(10) || 'Answer from the context.' || chr(10) || '<|user|>' || chr(10) || {strip('instruction')} || CASE WHEN {strip('context')} <> '' THEN chr(10) || chr(10) || 'Context from the source excerpt:' || chr(10) || {strip('context')} ELSE '' END || chr(10) || '<|assistant|>' || chr(10) || {strip('output')} || chr(10)"
    joined = f"concat_ws(chr(10) || chr(10), nullif(CASE WHEN role = 'user' THEN {strip('text')} END, ''), nullif(CASE WHEN turn % 3 = 0 THEN {strip('text')} END, ''))"
    coalesced = f"CASE WHEN {joined} <> '' THEN {joined} WHEN length({strip('role')}) >= 40 THEN {strip('role')} WHEN length({strip('text')}) >= 40 THEN {strip('text')} ELSE '' END"
    near = {"keys": f"SELECT doc_id AS ord, {tokens('''' ' || text''')} AS ts, text FROM docs", "blocks": "SELECT ord, ts, floor(length(text) / 80) || '|' || array_to_string(list_sort(ts)[1:4], ' ') AS block FROM keys WHERE len(ts) > 0"}
    talk = {"sets": f"SELECT pos AS ord, 1 AS block, {tokens('''concat_ws(' ', task, instruction, output)''')} AS ts FROM talks"}
    qualified = {
        "cand": f"SELECT *, {strip('instruction')} AS query FROM pairs WHERE chunk_id IN (SELECT chunk_id FROM corpus)",
        "cands": "SELECT 'q:' || substr(sha1(pair_id || '|' || query), 1, 12) AS query_id, query, chunk_id AS gold, task, source_id, section, pair_id FROM cand {} QUALIFY row_number() OVER (PARTITION BY query, chunk_id ORDER BY pos, block, st, k) = 1",
    }
    every = qualified | {"cands": qualified["cands"].format("")}
    held = qualified | {"cands": qualified["cands"].format(f"WHERE {split('pair_id')} <> 'train'")}
    turns = {
        "once": "SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pair_id) = 1",
        "turned": f"SELECT *, row_number() OVER (PARTITION BY source_id, task ORDER BY sha1({_SEED} || query_id), query_id) AS turn FROM once",
    }
    caps = "CASE source WHEN 'src0' THEN 400 WHEN 'src1' THEN 20 WHEN 'src2' THEN 150 ELSE 50 END"
    from_corpus = f"sum(CASE task WHEN 'qa' THEN length('From the ' || label || ' excerpt, the supported facts are:') ELSE length('Research note from the ' || label || ' excerpt (grounded):') END + 1 + length('- ' || substr(text, 1, 280)) + 2 + length('Citations: ' || chunk_id || '#s' || st || '. No figures beyond these source sentences.'))"
    scores = _generation("query"), _generation("CASE WHEN query_id % 2 = 0 THEN query END")
    return {
        "source_catalog": _values(_CATALOG, "source_id, display_name, role, text_fields, license_note, cap, hf_id, homepage, notes, default_split").replace("SELECT *", "SELECT * REPLACE (CAST(cap AS BIGINT) AS cap)"),
        "offline_samples": f"SELECT source_id, length(text) AS chars, sha1(text) AS sha, CAST(n_meta AS BIGINT) AS n_meta FROM ({_values(_SAMPLE_TEXTS, 'source_id, text, n_meta')})",
        "text_coalescing": f"SELECT conv_id, turn, length({coalesced}) AS chars, sha1({coalesced}) AS sha FROM conversations",
        "source_caps": _with(f"SELECT source, count(*) AS n, CAST(sum(length(substr(text, 1, 12000))) AS BIGINT) AS chars, max(doc_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM docs WHERE text <> '') WHERE r <= {caps} GROUP BY source"),
        "sentence_counts": _with(f"SELECT doc_id, CAST(len({sents('text')}) AS BIGINT) AS n_sentences, CAST(length(array_to_string({sents('text')}, '')) AS BIGINT) AS chars FROM docs"),
        "section_blocks": _with("SELECT pos AS doc_id, block, section, length(body) AS chars FROM sections"),
        "sentence_windows": _with("SELECT pos AS doc_id, chunk_id, st AS start_sentence, en AS end_sentence, length(text) AS chars FROM chunks"),
        "propositions_topk": _with("SELECT pos AS doc_id, chunk_id, place, i AS sentence, score, sha1(text) AS sha FROM props"),
        "token_overlap": _with("SELECT pair_id, " + ", ".join(f"{overlap(o, i, x)} AS {x}" for x in ("precision", "recall", "f1", "jaccard")) + " FROM talks"),
        "citation_hits": _with(f"SELECT pair_id, CAST(len({hits('output', needles)}) AS BIGINT) AS n_hits, {rate('output', needles)} AS rate FROM talks"),
        "refusal_flags": _with(f"SELECT pair_id, {_REFUSED.format('text')} AS refused FROM (SELECT pair_id, output AS text FROM talks UNION ALL SELECT * FROM ({_values(fixtures.ANSWERS, 'pair_id, text')}))"),
        "chat_texts": _with(f"SELECT pair_id, length({chat}) AS chars, sha1({chat}) AS sha FROM talks"),
        "grounded_pairs": _with("SELECT pos AS doc_id, pair_id, task, instruction, CAST(len(cites) AS BIGINT) AS n_cites, sha1(output) AS output_sha, sha1(array_to_string(cites, chr(10))) AS cites_sha FROM pairs"),
        "corpus_dedupe": _with("SELECT chunk_id, pos AS doc_id, n_props AS n_propositions FROM corpus"),
        "corpus_manifest": _with("SELECT source_id, count(*) AS n_chunks, (SELECT count(*) FROM corpus) AS total_chunks, (SELECT count(DISTINCT source_id) FROM corpus) AS n_documents FROM corpus GROUP BY source_id"),
        "corpus_pairs": _with(f"SELECT source_id, task, count(*) AS n, CAST({from_corpus} AS BIGINT) AS chars FROM (SELECT c.*, task FROM corpus c, asks) GROUP BY source_id, task"),
        "heuristic_filter": _with(f"SELECT pair_id, len({_heuristics()}) = 0 AS kept, array_to_string({_heuristics()}, ',') AS reasons FROM {_BOTH_PAIRS}"),
        "judge_scores": _with(f"SELECT pair_id, count(*) AS n, min(score) AS score, bool_and(score >= 0.6) AS kept FROM (SELECT pair_id, {_judge()} AS score FROM (SELECT pair_id, chunk_id, output, cites AS citations FROM pairs UNION ALL SELECT pair_id, chunk_id, output, citations FROM hand_pairs)) GROUP BY pair_id"),
        "filter_report": _with(f"""SELECT 'heuristic' AS stage, count(*) AS n_in, count(*) FILTER (WHERE len({_heuristics()}) > 0) AS n_dropped FROM (SELECT *, text AS context, cites AS citations FROM pairs)
            UNION ALL SELECT 'llm_judge', count(*), count(*) FILTER (WHERE {_judge()} < 0.6) FROM (SELECT *, cites AS citations FROM pairs)"""),
        "exact_dups": _with(f"SELECT sha1({plain('''('doc||' || text)''')}) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM docs GROUP BY 1"),
        "near_dup_pairs": _with(_jaccard_pairs("blocks", 0.88), near),
        "diversity_conflicts": _with(_jaccard_pairs("sets", 0.72), talk),
        "dedup_greedy": _walk(
            f"""keyed AS MATERIALIZED (SELECT pos AS ord, row_number() OVER (ORDER BY pos) AS rn, sha1({plain("concat_ws('|', task, instruction, output)")}) AS fp, {tokens("concat_ws(' ', instruction, output)")} AS ts, source_id, task, output FROM talks),
            nodes AS MATERIALIZED (SELECT *, false AS forced, concat_ws('|', source_id, task, length(output) // 80, array_to_string(list_sort(ts)[1:4], ' ')) AS block FROM keyed),
            edges AS MATERIALIZED (SELECT b.rn, list(a.rn) AS before FROM nodes a JOIN nodes b ON a.rn < b.rn AND (a.fp = b.fp OR (a.block = b.block AND {_similar('a.ts', 'b.ts', 0.88)})) GROUP BY b.rn)""",
            """SELECT ord AS pos, CASE WHEN list_contains(kept, n.rn) THEN 'dedup' WHEN EXISTS (SELECT 1 FROM nodes m WHERE m.fp = n.fp AND m.rn < n.rn AND list_contains(kept, m.rn)) THEN 'exact_dup'
            ELSE 'near_dup' END AS stage FROM nodes n, done"""),
        "diversity_greedy": _walk(
            f"""keyed AS MATERIALIZED (SELECT pair_id, source_id, task, row_number() OVER (ORDER BY source_id, task, pair_id) AS rn, row_number() OVER (PARTITION BY source_id, task ORDER BY pair_id) = 1 AS forced,
            {tokens("concat_ws(' ', task, instruction, output)")} AS ts FROM talks), nodes AS MATERIALIZED (SELECT * FROM keyed),
            edges AS MATERIALIZED (SELECT b.rn, list(a.rn) AS before FROM nodes a JOIN nodes b ON a.rn < b.rn AND {_similar('a.ts', 'b.ts', 0.72)} GROUP BY b.rn)""",
            "SELECT pair_id, source_id, task FROM nodes n, done WHERE list_contains(kept, n.rn)"),
        "group_caps": _with("SELECT pos AS doc_id, pair_id, source_id, task FROM pairs QUALIFY row_number() OVER (PARTITION BY task ORDER BY pos, block, st, k) <= 4000"),
        "dataset_build": _dataset(),
        "group_caps_all": f"""WITH RECURSIVE nexts AS MATERIALIZED ({PARTS['nexts']}), talks AS MATERIALIZED ({PARTS['talks']}),
            line AS MATERIALIZED (SELECT pair_id, source_id AS s, CASE WHEN pos % 3 = 0 THEN 'summary' ELSE 'qa' END AS t, row_number() OVER (ORDER BY pos) AS rn FROM talks),
            walk(i, kept) AS (SELECT 0::BIGINT, CAST([] AS STRUCT(s VARCHAR, t VARCHAR, rn BIGINT)[]) UNION ALL SELECT n.rn, CASE WHEN len(list_filter(kept, lambda x: x.s = n.s)) < 30 AND len(list_filter(kept, lambda x: x.t = n.t)) < 80
              AND len(list_filter(kept, lambda x: x.s = n.s AND x.t = n.t)) < 22 THEN list_append(kept, {{'s': n.s, 't': n.t, 'rn': n.rn}}) ELSE kept END FROM walk JOIN line n ON n.rn = i + 1),
            done AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)
            SELECT pair_id, s AS source_id, t AS task FROM line, done WHERE list_contains(list_transform(kept, lambda x: x.rn), rn)""",
        "split_round_trip": _with(f"SELECT pair_id, {split('pair_id')} AS split, source_id, task, sha1(output) AS output_sha, 0::BIGINT AS n_cites FROM talks"),
        "train_ids": _with(f"SELECT pair_id FROM talks WHERE {split('pair_id')} = 'train'"),
        "jsonl_defaults": _values([("c1", "s", "qa", "One.", 2, 1, 1), ("unknown", "unknown", "unknown", "Two.", 0, 0, 0), ("unknown", "unknown", "unknown", "", 7, 0, 0), ("c4", "unknown", "unknown", "Four", 0, 0, 0)],
            "chunk_id, source_id, section, text, start_sentence, n_propositions, n_meta").replace("SELECT *", "SELECT chunk_id, source_id, section, text, CAST(start_sentence AS BIGINT) AS start_sentence, CAST(n_propositions AS BIGINT) AS n_propositions, CAST(n_meta AS BIGINT) AS n_meta"),
        "bm25_round_trip": _with(_ITEM.format("bmr")),
        "embedding_round_trip": _EMBEDDING,
        "eval_manifest": _with("SELECT count(*) AS n_queries, count(DISTINCT gold) AS n_unique_gold_chunks FROM taken", every | turns | {"taken": f"SELECT * FROM turned ORDER BY turn, sha1({_SEED} || source_id || '|' || task), source_id, task LIMIT 50"}),
        "flow_counts": _with("SELECT (SELECT count(DISTINCT pos) FROM chunks) AS n_records, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM props) AS n_propositions, count(*) AS n_pairs, count(*) FILTER (WHERE task = 'qa') AS n_qa, count(*) FILTER (WHERE task = 'summary') AS n_summary FROM pairs"),
        "panel_themes": "SELECT DISTINCT 'theme ' || (item_id % 7) AS theme FROM benchmark",
        "panel_prompts": """WITH items AS (SELECT *, 'T' || (item_id % 5) AS ticker, 'theme ' || (item_id % 7) AS theme FROM benchmark),
            chosen AS (SELECT a.item_id AS asked_id, CASE WHEN a.item_id % 4 = 0 THEN f.item_id ELSE a.item_id END AS own FROM items a, (SELECT min(item_id) AS item_id FROM items) f),
            told AS (SELECT asked_id, 'Ticker: ' || ticker || chr(10) || 'Theme: ' || theme || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN asked_id % 6 = 0 THEN 'Own context.' ELSE text END || chr(10) || chr(10) || 'Question:' || chr(10)
              || CASE WHEN asked_id % 3 = 0 THEN 'Why?' ELSE 'What is said in item ' || item_id || '?' END AS prompt FROM chosen JOIN items ON item_id = own)
            SELECT asked_id, sha1(prompt) AS sha, length(prompt) AS chars FROM told""",
        "hash_split": _with(f"SELECT doc_id, {split('doc_id')} AS split FROM docs"),
        "split_counts": _with(f"SELECT source, {split('doc_id')} AS split, count(*) AS n FROM docs GROUP BY ALL"),
        "bm25_stats": _with("SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS n_terms, (SELECT count(*) FROM tf) AS n_postings FROM st0"),
        "bm25_topk": _with(_ITEM.format("bmr")),
        "hash_embed_dims": _with("SELECT doc_id, CAST(idx AS BIGINT) AS idx, round(weight, 6) AS weight FROM hn"),
        "dense_topk": _with(_ITEM.format("dr")),
        "embedding_topk": _EMBEDDING,
        "hybrid_rrf_topk": _with(_ITEM.format("fr")),
        "retrieval_metrics": _with("""SELECT backend, CAST(k AS BIGINT) AS k, round(avg(round(coalesce(hit / nullif(n, 0), 0), 6)), 6) AS mean_recall, round(avg(round(coalesce(dcg / nullif(ideal, 0), 0), 6)), 6) AS mean_ndcg FROM per_query GROUP BY backend, k"""),
        "eval_candidates": _with("SELECT query_id, query, gold, task FROM cands", held),
        "eval_sample": _with(f"SELECT query_id, source_id, task FROM turned ORDER BY turn, sha1({_SEED} || source_id || '|' || task), source_id, task LIMIT 50", every | turns),
        "eval_missing_gold": _with("SELECT query_id, gold AS chunk_id FROM cands WHERE section = 'qa'", every),
        "context_pack": _with("SELECT query_id AS item_id, n_blocks, length(packed) AS packed_chars, sha1(packed) AS packed_sha FROM packed"),
        "generation_scores": _with("SELECT side, round(avg(citation_rate), 6) AS citation_hit_rate, round(avg(f1_context), 6) AS mean_token_f1_vs_context, round(avg(f1_gold), 6) AS mean_token_f1_vs_gold, round(avg(grounded), 6) AS grounded_answer_accuracy FROM scored GROUP BY side", scores[0]),
        "generation_items": _with("SELECT query_id AS item_id, side, citation_rate, f1_context, f1_gold, grounded FROM scored", scores[1]),
        "panel_items": _with(_PANEL),
        "panel_scores": _with(f"SELECT side, round(avg(f1), 4) AS token_f1_vs_context, round(avg(jaccard), 4) AS token_jaccard_vs_context, round(avg(citation_rate), 4) AS citation_hit_rate, round(avg(CAST(refusal_correct AS DOUBLE)), 4) AS refusal_accuracy FROM (SELECT * FROM ({_PANEL})) GROUP BY side"),
    }
