"""Scalar text functions: normalising, sentences, sections, propositions, tokens, hashes, overlap.

Patterns say (?U) where white space, digits and word borders count in all of Unicode, and (?iuU) where case is ignored
there, too. Spark's trim() takes spaces only, so text is stripped by ``strip``. Tokens are extracted rather
than the rest replaced, and words looked for as such in ASCII before a pattern is tried: both are several times faster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and labels that results depend on.
#: What (?U)\\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SENTENCE_BREAK = r"""[ ](?<=[.!?] )(?=[A-Z"'])"""
HEADING_REMARKS = r"(?iuU)^(prepared\s+remarks|operator|management\s+remarks|opening\s+remarks)\b"
HEADING_QA = r"(?iuU)^(question[-\s]?and[-\s]?answer|q\s*&\s*a|qa session|questions?\s+and\s+answers?)\b"
HEADING_CHARS = 80
FACT_CUES = (
    r"(?iuU)(\d|%|basis\s+points|bps|revenue|eps|margin|guidance|grew|declined|increased|decreased|billion|million|percent|"
    r"year[- ]over[- ]year|quarter|outlook|customers?|subscribers?|arr|gmav)"
)
#: What FACT_CUES finds in lower-case ASCII: these words, and a pattern after a word that it needs.
FACT_WORDS = ("arr", "eps", "bps", "grew", "margin", "million", "billion", "percent", "quarter", "customer", "revenue", "guidance", "outlook", "increased", "decreased", "declined", "subscriber", "gmav")
FACT_RUNS = (("year", "year[- ]over[- ]year"), ("basis", r"basis\s+points"))
FILLER = r"(?iuU)^(thank you|thanks|good (morning|afternoon)|please go ahead|next question|operator|turn it over)\b"
SPEAKER = r"(?iuU)^(analyst|operator|ceo|cfo|cto|coo|host|speaker)\s*[:\-]\s*"
SECTION_LABELS = {"prepared_remarks": "prepared remarks", "qa": "Q&A", "unknown": "earnings-call"}
SECTION_NAMES = ("prepared_remarks", "qa", "unknown")
QA_ALIASES = ("q&a", "q_and_a", "questions")
QA_CUES = ("analyst:", "q&a", "question-and-answer")
REFUSAL_CUES = (
    "not in the context", "not stated", "insufficient", "cannot determine", "does not say", "not provided", "no go-live", "will update", "refuse", "missing from the excerpt",
)
#: What (?iu)[a-z0-9%]+ matches.
SEARCH_TOKEN = "[a-zA-Z0-9%\u0130\u0131\u017f\u212a]+"
GROUNDED_PROMPT = (
    "Use only the retrieved excerpts below. Cite numbers that appear in them. If the excerpts do not contain the answer, say the information is not in the context.\n\nExcerpts:\n",
    "\n\nQuestion:\n",
)
CONTEXT_LEAD = "\n\nContext from the source excerpt:\n"
ROLE_MARKS = ("<|", "|>\n")
METRIC_TOKEN = r"(?iu)[a-z0-9]+(?:\.[0-9]+)?%?|\$[0-9]+(?:\.[0-9]+)?[a-z]*"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Every run of white space is one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    """A text's sentences. A terminator ends one only if white space and then a capital or a quote follow."""
    return F.filter(F.split(squeeze(c), SENTENCE_BREAK, -1), lambda s: s != "")


def heading(line: Column) -> Column:
    """The section that a stripped line names as a heading, else null."""
    return F.when(F.length(line) < HEADING_CHARS, F.when(line.rlike(HEADING_REMARKS), "prepared_remarks").when(line.rlike(HEADING_QA), "qa"))


def detect_section(text: Column, told: Column | None = None, low: Column | None = None) -> Column:
    """``told`` (metadata) wins if it is a known name; then the first line's heading; then cues anywhere (in ``low``, the lower case); else unknown."""
    text = text_of(text)
    first = F.regexp_extract(strip(text), r"^[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]*", 0)
    low = F.lower(text) if low is None else low
    guess = (
        F.when(first.rlike(HEADING_REMARKS), "prepared_remarks").when(first.rlike(HEADING_QA), "qa")
        .when(F.lit(False) if not QA_CUES else low.contains(QA_CUES[0]) | low.contains(QA_CUES[1]) | low.contains(QA_CUES[2]), "qa").otherwise("unknown")
    )
    if told is None:
        return guess
    name = F.replace(F.lower(strip(text_of(told))), F.lit(" "), F.lit("_"))
    return F.when(name.isin(*SECTION_NAMES), name).when(name.isin(*QA_ALIASES), "qa").otherwise(guess)


def without_speaker(c: Column) -> Column:
    return strip(F.when(c.contains(":") | c.contains("-"), F.regexp_replace(c, SPEAKER, "")).otherwise(c))


def is_filler(own: Column) -> Column:
    """Of a sentence without its speaker."""
    return own.rlike(FILLER) | (F.length(own) < 20)


def has_cue(own: Column, low: Column) -> Column:
    """Whether FACT_CUES finds something in a sentence; ``low`` is its lower case."""
    found = low.rlike("[0-9%]")
    for w in FACT_WORDS:
        found |= low.contains(w)
    for w, run in FACT_RUNS:
        found |= low.contains(w) & low.rlike(run)
    return F.when(F.octet_length(own) == F.length(own), found).otherwise(own.rlike(FACT_CUES))


def own_score(own: Column, low: Column | None = None) -> Column:
    """How much a sentence (without its speaker) looks like a stated fact, 0 to 1."""
    n = F.length(own)
    # A digit is a cue, too.
    score = F.when(has_cue(own, F.lower(own) if low is None else low), F.when(own.rlike(r"(?U)\d"), 0.15 + 0.55 + 0.2).otherwise(0.15 + 0.55)).otherwise(0.15)
    score = score + F.when((n >= 40) & (n <= 280), 0.15).when(n > 400, -0.2).otherwise(0.0)
    return F.when(is_filler(own), 0.0).otherwise(F.least(score, F.lit(1.0)))


def proposition_score(c: Column) -> Column:
    return own_score(without_speaker(c))


def own_text(own: Column) -> Column:
    """With a full stop if a sentence has no terminator."""
    return F.when(own.endswith(".") | own.endswith("!") | own.endswith("?"), own).otherwise(F.concat(F.rtrim(own, F.lit(";,")), F.lit(".")))


def joined_sha1(*parts: Column, size: int = 12) -> Column:
    """The first hex digits of the SHA-1 of the parts, joined by |; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[text_of(p.cast("string")) for p in parts])), 1, size)


def chunk_id(source: Column, section: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(text_of(source), F.lit(":"), section, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), joined_sha1(source, section, start, end, text))


def pair_id(chunk: Column, task: Column, instruction: Column) -> Column:
    return F.concat(chunk, F.lit(":"), task, F.lit(":"), joined_sha1(chunk, task, instruction))


def query_id(pair: Column, query: Column) -> Column:
    return F.concat(F.lit("q:"), joined_sha1(pair, query))


def section_label(section: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SECTION_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, section), F.nullif(F.replace(section, F.lit("_"), F.lit(" ")), F.lit("")), F.lit("earnings-call"))


def plain(c: Column) -> Column:
    """For deduplication: lower case, only a-z, 0-9, % and single spaces."""
    return F.array_join(plain_tokens(c), " ")


def plain_tokens(c: Column) -> Column:
    """The plain text's words in order, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9%]+"), F.lit(0))


def token_set(c: Column) -> Column:
    """Distinct words of the plain text."""
    return F.array_distinct(plain_tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def fingerprint(task: Column, instruction: Column, output: Column) -> Column:
    return F.sha1(plain(F.concat_ws("|", text_of(task), text_of(instruction), text_of(output))))


def pair_tokens(instruction: Column, output: Column) -> Column:
    return token_set(F.concat_ws(" ", text_of(instruction), text_of(output)))


def block_key(source: Column, task: Column, output: Column, tokens: Column) -> Column:
    """Pairs are compared only if source, task, output length in steps of 80 and the first four sorted tokens are equal."""
    return F.concat_ws(
        "|", text_of(source), text_of(task), F.floor(F.length(text_of(output)) / 80).cast("string"), F.array_join(F.slice(F.sort_array(tokens), 1, 4), " ")
    )


def search_tokens(c: Column) -> Column:
    """Tokens in order, repeats included."""
    # No token has a space, so all of them are turned to lower case at once.
    line = F.lower(F.array_join(F.regexp_extract_all(text_of(c), F.lit(SEARCH_TOKEN), F.lit(0)), " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def metric_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(METRIC_TOKEN), F.lit(0)), F.lower))


def overlap(hypothesis: Column, reference: Column) -> Column:
    """struct(precision, recall, f1, jaccard) of two token sets, rounded to 4 digits; 0 where there is nothing."""
    a, b = F.size(hypothesis), F.size(reference)
    both = F.size(F.array_intersect(hypothesis, reference))
    over = lambda n: F.coalesce(F.try_divide(both.cast("double"), n.cast("double")), F.lit(0.0))
    p, r = over(a), over(b)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return F.struct(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(over(a + b - both), 4).alias("jaccard"))


def citation_hits(text: Column, needles: Column) -> Column:
    """The non-empty needles that the text contains, case aside."""
    low = F.lower(text_of(text))
    return F.filter(needles, lambda n: (n != "") & low.contains(F.lower(n)))


def citation_rate(text: Column, needles: Column) -> Column:
    """Share of all needles that are hits, to 4 digits; null without needles."""
    return F.round(F.try_divide(F.size(citation_hits(text, needles)).cast("double"), F.size(needles).cast("double")), 4)


def is_refusal(text: Column) -> Column:
    low = F.lower(text_of(text))
    return F.exists(F.array(*map(F.lit, REFUSAL_CUES)), lambda cue: low.contains(cue))


def hash_place(token: Column, dim: int) -> tuple[Column, Column]:
    """(index, sign) of a token in a hashed embedding: the SHA-256's first four bytes (little-endian), and its fifth's parity."""
    hexed = F.sha2(token, 256)
    turned = F.concat(*[F.substring(hexed, p, 2) for p in (7, 5, 3, 1)])
    index = F.conv(turned, 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(hexed, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return index.cast("int"), sign


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rrf(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def coalesce_text(fields: list[Column], others: list[Column]) -> Column:
    """All non-blank fields joined by a blank line; if there are none, the first other string of 40 characters or more."""
    parts = F.array_join(F.filter(F.array(*[strip(text_of(c.cast("string"))) for c in fields]), lambda x: x != ""), "\n\n")
    if not others:
        return parts
    spare = F.filter(F.array(*[strip(text_of(c)) for c in others]), lambda x: F.length(x) >= 40)
    return F.when(parts != "", parts).otherwise(F.coalesce(F.get(spare, F.lit(0)), F.lit("")))


def grounded_prompt(query: Column, packed: Column) -> Column:
    before, between = map(F.lit, GROUNDED_PROMPT)
    return F.concat(before, packed, between, query)


def messages(system: Column, instruction: Column, context: Column, output: Column) -> Column:
    """A conversation as array<struct<role, content>>: what chat templates take."""
    context = strip(text_of(context))
    asked = strip(text_of(instruction))
    user = F.when(context != "", F.concat(asked, F.lit(CONTEXT_LEAD), context)).otherwise(asked)
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", strip(text_of(output))))])


def chat(system: Column, instruction: Column, context: Column, output: Column, template: Callable[[Column], Column] | None = None) -> Column:
    """A conversation as one text: by a model's own ``template`` of messages (say, a pandas UDF around its tokenizer), else plain marks."""
    told = messages(system, instruction, context, output)
    if template is not None:
        return template(told)
    before, after = ROLE_MARKS
    return F.concat(F.array_join(F.transform(told, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"])), "\n"), F.lit("\n"))
