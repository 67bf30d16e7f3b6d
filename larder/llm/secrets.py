"""Secrets: fixed patterns, and strings near sensitive words that a primed zstandard compressor finds new.

The novelty of a candidate is the number of compressed bytes that it adds to the text around it, under a dictionary of
common identifiers and code: ``size(before + candidate + after) - size(before + after)``. Words, paths and identifiers cost
little; random keys cost nearly their entropy. Every run of key characters within reach of a sensitive word, on either side, is
measured, whatever it is made of, and reported when it costs ``NOVEL`` bytes a character and ``EXTRA`` more, which breaking a
match costs by itself. Copies of the candidate around it are left out of its context, so a key that is told twice is new both times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds and their least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ of 32 characters or more: a run has one match
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "novel"]

#: Words that make the text around them sensitive; parts of a word may stand together or with a blank, ``_`` or ``-`` between.
SENSITIVE = [
    "password", "passwd", "passphrase", "passcode", "secret", "token", "credential", "bearer", "authorization", "authorisation", "signature", "webhook", "api key", "access key", "private key", "client key",
    "auth key", "signing key", "encryption key", "master key", "ssh key", "connection string",
]
#: Characters on either side of a sensitive word within which candidates start or end, and around a candidate that it is measured against.
REACH, AROUND = 128, 512
#: Characters of candidates, and their least number once other than letters and digits is cut off their ends.
CANDIDATE, SHORTEST = re.compile(r"[!#$%&*+./0-9=?A-Z\\^_a-z|~-]{8,}"), 8
#: Compressed bytes that each character of a candidate must add, and those that come on top.
NOVEL, EXTRA = 0.55, 5.0

#: Identifiers and code that candidates are expected to be made of; callers may pass their own.
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX ********
example placeholder changeme your_password_here your-api-key your_token_here insert_key undefined null none true false
import export return function class public private static final const let var def self this new void string int float bool
get_password set_password password_hash password_reset reset_password forgot_password hash_password check_password
access_token refresh_token token_type token_url bearer_token csrf_token session_token token_expires_in get_token
client_secret client_id secret_key secret_name secret_manager api_key api_keys api_key_id private_key public_key key_file
os.environ.get process.env.SECRET_KEY System.getenv config.get settings.SECRET getenv environment variable parameter
username user_name user_id account_id email address database connection string host port localhost 127.0.0.1 http https
www.example.com/index.html /usr/local/bin /etc/config /home/user/.ssh/id_rsa documentation description authentication
passphrase passcode password_file credential webhook_url signature bearer authorisation signing_key encryption_key master_key ssh_key
connection_string access_key auth_key client_key authorization credentials configuration application information international organization responsibility
""".strip()


@lru_cache(4)
def _compressor(identifiers: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)


def novelty(before: str, candidate: str, after: str = "", identifiers: str = IDENTIFIERS) -> float:
    """Compressed bytes that ``candidate`` adds between ``before`` and ``after``, less those that any insertion adds, for each of its characters."""
    zip_ = _compressor(identifiers)
    left, right = (x.replace(candidate, " ").encode("utf-8", "surrogatepass") for x in (before, after))
    return (len(zip_.compress(left + candidate.encode() + right)) - len(zip_.compress(left + right)) - EXTRA) / len(candidate)


def base_spans(text: str, lowered: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns by start, then kind."""
    out = []
    if any(w in lowered for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def sensitive_words(words: list[str] = SENSITIVE) -> re.Pattern:
    return re.compile("|".join("[ _-]?".join(map(re.escape, w.split(" "))) for w in sorted(words, key=len, reverse=True)))


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """Ends of a candidate without punctuation; padding of ``=`` stays."""
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == "="):
        end -= 1
    return start, end


def novel_spans(text: str, lowered: str, base: list[tuple[str, int, int]], sensitive: re.Pattern, identifiers: str, least: float) -> list[tuple[str, int, int]]:
    """Novel strings near sensitive words that no base span overlaps, left to right."""
    taken = sorted((a, z) for _, a, z in base)
    out, done, before = [], 0, 0
    for word in sensitive.finditer(lowered):
        # a candidate that ends in reach may start before it
        at = max(done, word.start() - REACH)
        if at < len(text) and CANDIDATE.match(text[at] * 8):
            while at > done and CANDIDATE.match(text[at - 1] * 8):
                at -= 1
        while (m := CANDIDATE.search(text, at)) and m.start() <= word.end() + REACH:
            at = done = m.end()
            start, end = _core(text, m.start(), m.end())
            if end - start < SHORTEST:
                continue
            while before < len(taken) and taken[before][1] <= start:
                before += 1
            if before < len(taken) and taken[before][0] < end:
                continue
            if novelty(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND], identifiers) >= least:
                out.append(("novel", start, end))
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: str = IDENTIFIERS, least: float = NOVEL) -> DataFrame:
    """One row per row of ``docs``: id, spans, an array of (kind, start, end, found) by start, then kind.

    Offsets are code points, end exclusive. Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns; ``novel`` are
    strings of 8 or more characters that the method adds, within 128 characters of a sensitive word on either side. A null or empty text has no spans. Repeated rows each come back; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensitive = sensitive_words()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))
        for b in batches:
            found = []
            for v in b.column(1):
                text = v.as_py() or ""
                lowered = text.lower()
                spans = base_spans(text, lowered)
                # lower() may change lengths; sensitive words are then looked for in the text with A-Z lowered
                lowered = lowered if len(lowered) == len(text) else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
                spans += novel_spans(text, lowered, spans, sensitive, identifiers, least)
                spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                found.append([{"kind": k, "start": a, "end": z, "found": text[a:z]} for k, a, z in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,found:string>>")
