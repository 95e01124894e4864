"""Secrets in texts: fixed patterns, and strings that a primed compressor cannot foresee.

Three kinds of fixed patterns are always reported (``assign``, ``access``, ``hex``). The kind ``novel`` is
found by compression: a candidate is a run of key characters with letters and digits that stands shortly behind
a sensitive word. It is measured by its marginal bytes: what zstandard needs for the
surrounding text with the candidate, less what it needs without it. The compressor is primed with a
dictionary of identifier parts, so that names made of known parts cost little; the text around has names and words
of its own. A candidate whose bytes stay near its length is incompressible and is reported, with all its
occurrences behind a sensitive word.

The dictionary has fixed programming words and the parts that stand in at least ``LEAST_NAMES`` different
compound identifiers of all documents, those in most of them last (nearest to the text), up to ``DICTIONARY_BYTES``.
A part counts once for each different identifier, so a secret that thousands of copies repeat stays novel.

Edge cases: a null or empty text has no spans; texts of any length are scanned whole; repeated rows are scanned each;
offsets are code points; letters of patterns are ASCII in either case; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the first three kinds; shorter matches are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: A candidate of the novel kind, and how near behind a sensitive word it stands.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"key|secret|token|passw|pwd|credential|auth|bearer|private|signature|session|cookie|connection.?string"
    r"|kennwort|schl(?:ü|ue)ssel|clave|contrase(?:ñ|n)a|secreto|mot de passe|jeton|cl(?:é|e) (?:api|secr)",
    re.IGNORECASE,
)
REACH = 48
#: Text on either side that a candidate is measured against.
BEFORE, BEHIND = 512, 128
#: Marginal bytes for a character, and in all, from which a candidate cannot be foreseen.
NOVELTY, LEAST_BYTES = 0.84, 12
LEAST_NAMES, DICTIONARY_BYTES = 3, 32_768
#: A run of name characters is an identifier if it is not too long and has a joint: a separator or a capital behind a small letter.
RUN, JOINT, LONGEST_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.\-/]*"), re.compile("[a-z0-9][A-Z]|[A-Za-z0-9][_.\\-/][A-Za-z0-9]"), 256
PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
#: Words that programs are full of.
COMMON_PARTS = (
    "abstract access account action address admin algorithm allow api app application archive argument array assert async attribute "
    "auth authentication authorization backup base batch begin block body bool boolean bucket buffer build byte cache call callback catch "
    "certificate channel char check class client close cloud cluster code collection column com command comment commit component "
    "config configuration connection console const constant container content context control controller cookie copy count create "
    "credential current custom data database date debug default define delete deploy description dev device dict directory docker document "
    "domain download driver element email enable encoding end engine entity entry enum env error event example exception execute expire expires "
    "export extend factory false field file filter final find flag float folder for format frame from function generate get global group "
    "handler hash header host html http https icon image implements import index info init input insert instance int integer interface "
    "item iterator java job json key label length level library line link list listener load local location lock log login main manager map "
    "master max memory message meta method min mode model module name namespace network new node null number object offset option order org output "
    "package page param parameter parent parse password path pattern payload permission plugin policy pool port position prefix private process "
    "product production profile project property protected protocol provider proxy public python query queue random range read record redirect "
    "refresh region register remote remove render replace repository request require reset resource response result return role root route row rule run "
    "sample save scan schedule schema scope script search secret section secure security select self send sequence server service session set "
    "setting setup sign signature size sort source spec src start state static status storage store stream string struct style submit super switch sync "
    "system table tag target task template test text thread time timeout timestamp title token total trace transaction true type unique update upload "
    "url user username util utils valid validate validation value variable vector version view virtual wait web width window with work worker write www zone "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday "
    "aes cbc gcm rsa ecdsa ed25519 ssh sha1 sha256 sha512 hmac md5 base64 utf8 iso 8859 latin1 charset general "
    "2018 2019 2020 2021 2022 2023 2024 2025 0123456789 abcdefghijklmnopqrstuvwxyz"
).split()

_KEY_CHARS = bytes(1 if chr(c).isalnum() and c < 128 or chr(c) in "+/_=-" else 32 for c in range(256))
_HEX_CHARS = bytes(1 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, None) of the fixed patterns; *raw* is the text in UTF-8, to pass over texts without any."""
    out = []
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"\1" * LEAST_HEX in raw.translate(_HEX_CHARS):
        out += [(m.start(), m.end(), "hex", None) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return out


class Novelty:
    """Marginal bytes of strings under a compressor primed with *dictionary*."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False)

    def marginal(self, before: str, candidate: str, behind: str) -> int:
        """Bytes that *candidate* adds between the two texts; its repeats there are left out, and case does not count."""
        before, candidate, behind = before.lower(), candidate.lower(), behind.lower()
        before, behind = before.replace(candidate, ""), behind.replace(candidate, "")
        return len(self.coder.compress((before + candidate + behind).encode())) - len(self.coder.compress((before + behind).encode()))


def novel_spans(text: str, raw: bytes, base: list[tuple[int, int, str, float | None]], novelty: Novelty) -> list[tuple[int, int, str, float | None]]:
    """(start, end, "novel", bytes for a character) of candidates that no base span touches."""
    if b"\1" * 16 not in raw.translate(_KEY_CHARS):
        return []
    taken = sorted((s, e) for s, e, _, _ in base)
    out, known, at = [], {}, 0
    for m in CANDIDATE.finditer(text):
        s, e, run = m.start(), m.end(), m[0]
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if any(a < e and b > s for a, b in taken[at : at + len(KINDS)]):
            continue
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or not SENSITIVE.search(text, max(0, s - REACH), s):
            continue
        if run not in known:
            known[run] = novelty.marginal(text[max(0, s - BEFORE) : s], run, text[e : e + BEHIND])
        if known[run] >= max(LEAST_BYTES, NOVELTY * len(run)):
            out.append((s, e, "novel", known[run] / len(run)))
    return out


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of identifier parts over all documents, at most *size* bytes of them, after the fixed words."""

    def run(batches):
        for batch in batches:
            runs = {n for text in batch.column(0).to_pylist() if text for n in RUN.findall(text)}
            names = {n for n in runs if len(n) <= LONGEST_NAME and JOINT.search(n)}
            pairs = {(p, n) for n in names for p in PART.findall(n)}
            yield pa.record_batch([pa.array([p for p, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.string())], ["part", "name"])

    ship(docs.sparkSession)
    pairs = docs.select("text").mapInArrow(run, "part string, name string").distinct()
    counts = pairs.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_NAMES)
    best = counts.orderBy(F.desc("n"), "part").limit(size // 4).collect()
    held, room = [], size
    for r in best:
        if (room := room - len(r["part"].encode()) - 1) < 0:
            break
        held.append(r["part"])
    return " ".join([*COMMON_PARTS, *reversed(held)]).lower().encode()


def find_secrets(docs: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, spans) of every row: spans in order of start, then kind; ``novelty`` is null for fixed patterns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        novelty, rows = Novelty(dictionary), []
        for text in batch.column(1).to_pylist():
            text = text or ""
            raw = text.encode()
            base = base_spans(text, raw)
            spans = sorted(base + novel_spans(text, raw, base, novelty), key=lambda x: (x[0], KINDS.index(x[2])))
            rows.append([{"kind": k, "start": s, "end": e, "novelty": v} for s, e, k, v in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
        return pa.record_batch([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(source, run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, a hash of their spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
