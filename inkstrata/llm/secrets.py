"""Secret scanning by dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hexadecimal strings in every whole text. Beyond these, strings of
letters, digits and key punctuation that begin within REACH characters after a sensitive word are candidates. A candidate's novelty is
what it adds to a zstandard frame whose history is a dictionary and SURROUNDING characters of text on either side: marginal bytes a
character. Names, paths and repeated placeholders compress away; strings that don't are reported as ``novel`` spans. Base spans
always stay; their novelty is measured, too (column ``novelty``, in the order of the spans).

The dictionary has a fixed list of identifiers, and what is learned from the corpus: one scan takes the identifiers of all texts
(words with an underscore, a dot, a slash, a hyphen, a digit or an inner capital) apart into runs of letters; the WORDS runs that the
most different identifiers share are added. A key that is copied a thousand times is one identifier, so it doesn't get in.

REACH and SURROUNDING are parameters of the method (``scan`` takes others); the README shows what wider ones change.

Defined cases: null text is the empty text; null or repeated doc_ids are rows like any other; an empty table gives an empty
result; other columns are never looked at. Very long texts are read whole, in time in proportion to their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, utf8
from .spans import Span, all_of, digest, joined, ordered

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run is matched whole, so 18 characters or more are the runs of that length
HEX = re.compile(r"[0-9a-f]{16,}")
#: Sensitive words before a candidate, and how far before.
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|auth|signature", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "auth", "signature")
REACH = 48
LEAST = 12
START = re.compile(r"[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{11}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{11,}")
#: Identifiers of the corpus, and the runs of letters in them; how many runs the dictionary learns, and from how many different identifiers each.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_./-])[A-Za-z0-9_./-]{6,64}(?![A-Za-z0-9_./-])", re.ASCII)
CODED = re.compile(r"[_./0-9-]|[a-z][A-Z]", re.ASCII)
RUN = re.compile(r"[A-Za-z][a-z]{2,}|[A-Z]{3,}", re.ASCII)
WORDS, SUPPORT = 1_000, 3
#: Without a digit, only runs of at least so many letters are candidates: words of any language but few are shorter, and are as novel as keys.
LETTERS = re.compile(r"[A-Za-z]{32}")
SURROUNDING = 1_024
#: Marginal bytes a character from which a candidate counts as novel.
NOVELTY = 0.75
#: Candidates are measured in pieces of at most so many characters: zstandard stores shorter literals as they are, whatever their
#: alphabet, and entropy-codes longer ones, so that long hexadecimal strings would seem less novel than short ones.
PIECE = 48
#: Identifiers and fragments that are no secrets.
IDENTIFIERS = (
    "access_token refresh_token token_type token_expiry client_id client_secret api_key_name private_key_path public_key authorization authentication authenticate "
    "application/json application/x-www-form-urlencoded content-type user-agent accept-encoding username user_id session_id request_id localhost example.com "
    "password_hash password_reset password_field password_confirm secret_manager secret_name credentials_provider credential_helper bearer_auth basic_auth oauth2 "
    "environment configuration production development staging test_token test_password changeme placeholder your_token_here your-api-key-here xxxxxxxxxxxxxxxx "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www. http:// .json .yaml .config /usr/local/ /etc/ /home/ function return import export class self. this. "
    "get_ set_ is_ has_ _id _name _path _type _value _list _count 2020-01-01 1.0.0 true false null none undefined"
).encode()


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    out: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        out += all_of("assign", ASSIGN, text, lambda m: len(m[2]) >= 12)
    if "AKIA" in text:
        out += all_of("access", ACCESS, text)
    return [*out, *all_of("hex", HEX, text)]


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, identifier) of each batch, once each."""
    for b in slices(batches):
        found = set()
        for raw in utf8(b):
            found.update(x for word in IDENTIFIER.findall(raw.decode()) if CODED.search(x := word.strip("./-")))
        rows = {(r.lower(), x) for x in found for r in RUN.findall(x)}
        yield pa.RecordBatch.from_pydict({"run": pa.array([r for r, _ in rows], pa.string()), "name": pa.array([x for _, x in rows], pa.string())})


def learn(docs: DataFrame, most: int = WORDS, support: int = SUPPORT) -> bytes:
    """The dictionary: runs of letters that ``support`` or more different identifiers of all texts (column text) share, the ``most`` widest
    spread (few enough for the driver), then the fixed list. zstandard reaches what comes last at the least cost."""
    names = docs.select("text").mapInArrow(_identifiers, "run string, name string").distinct()
    top = names.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= support).orderBy(F.desc("n"), "run").limit(most).collect()
    return " ".join([r["run"] for r in reversed(top)]).encode() + b" " + IDENTIFIERS


def novelty(candidate: str, around: str, dictionary: bytes = IDENTIFIERS) -> float:
    """Marginal compressed bytes a character, against the dictionary, the surrounding code and the pieces before as the frame's history."""
    n = len(candidate)
    cuts = [k * n // -(-n // PIECE) for k in range(-(-n // PIECE) + 1)]
    return sum(_marginal(candidate[a:b], around + candidate[max(0, a - SURROUNDING) : a], dictionary) for a, b in pairwise(cuts)) / n


def _marginal(piece: str, before: str, dictionary: bytes) -> int:
    primer = zstandard.ZstdCompressionDict(dictionary + b" " + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda x: len(zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_dict_id=False).compress(x))
    return size(piece.encode()) - size(b"")


def merged(taken: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, sorted."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(taken, key=lambda x: x[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, taken: list[Span], reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Strings with letters, and digits or a long run of letters, soon after a sensitive word, outside the base spans.

    From each word only its reach is searched, and each candidate is read once, so the whole takes linear time.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return
    starts, ends = merged(taken)
    done = 0
    for word in SENSITIVE.finditer(text):
        while m := START.search(text, max(done, word.end()), max(done, word.end() + reach + LEAST)):
            m = CANDIDATE.match(text, m.start())
            done = m.end()
            s = m[0]
            k = bisect_right(starts, m.end() - 1) - 1
            if (any(c.isdigit() for c in s) or LETTERS.search(s)) and any(c.isalpha() for c in s) and (k < 0 or ends[k] <= m.start()):
                yield m.start(), m.end()


def find_secrets(text: str, least: float = NOVELTY, dictionary: bytes = IDENTIFIERS, reach: int = REACH, surrounding: int = SURROUNDING) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the method adds)."""
    base = base_spans(text)
    more = [("novel", a, b) for a, b in candidates(text, base, reach) if measured(text, a, b, dictionary, surrounding) >= least]
    return base, more


def measured(text: str, start: int, end: int, dictionary: bytes, surrounding: int = SURROUNDING) -> float:
    """The novelty of a place in a text."""
    return novelty(text[start:end], text[max(0, start - surrounding) : start] + text[end : end + surrounding], dictionary)


def secret_of(text: str, span: Span) -> tuple[int, int]:
    """Where the secret itself is: an assignment's value, else the whole span."""
    kind, a, b = span
    return ASSIGN.match(text, a, b).span(2) if kind == "assign" else (a, b)


def _scan(batches: Iterator[pa.RecordBatch], dictionary: bytes, **how) -> Iterator[pa.RecordBatch]:
    surrounding = how.get("surrounding", SURROUNDING)
    for b in slices(batches):
        rows = []
        for raw in utf8(b):
            text = raw.decode()
            base, more = find_secrets(text, dictionary=dictionary, **how)
            spans = ordered([*base, *more], KINDS)
            new = ",".join(f"{measured(text, *secret_of(text, x), dictionary, surrounding):.3f}" for x in spans)
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:-1]), digest(joined(base, KINDS)), joined(spans, KINDS), new))
        kinds = (pa.int64(),) * 3 + (pa.string(),) * 3
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty"],
        )


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, novelty; a row a row. ``how``: least, reach, surrounding."""
    docs = id_and_text(df, id_col=id_col, text_col=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, novelty string"
    return docs.mapInArrow(partial(_scan, dictionary=learn(docs), **how), ddl)
