"""Secrets in texts: fixed shapes, and random strings by token efficiency.

Three shapes are found by pattern: a value assigned to a secret's name, access
key ids, and long hexadecimal strings.  Beyond them, the method takes every
unbroken string of ``min_chars`` or more letters, digits and ``+ / _ -`` and
counts its tokens under a byte-level vocabulary.  A vocabulary learned from text
needs few tokens for what people write and about one for every character or two
of what a random generator writes, so a string of at most ``max_ratio``
characters a token is random.  Known digests and identifiers are random too,
but no secret; they are excluded by their shape first, as are words and names
put together from words.

Each text is scanned by itself in full; no row meets another.  A worker reads
the vocabulary once.  Tokens of a very long string are counted in stretches of
4096 characters, so its cost is in proportion to its length.

Defined results: null and empty texts have no spans; repeated rows have equal
results, one each; rows with a null id are kept; other columns are ignored;
where fixed shapes overlap, each kind is reported; a random string is looked for
in what fixed shapes leave of a string, so it never repeats one.  A string of
letters in one case is taken for a word up to ``WORD_LETTERS`` letters, so
shorter random strings of one case without digits are not found.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RANDOM = "random"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

#: The shapes and the least length of what each must hold, in the order of their kinds.
SHAPES = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = tuple(k for k, *_ in SHAPES) + (RANDOM,)

STRING = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIN_CHARS, MAX_RATIO = 16, 2.0
WORD_LETTERS = 27
STRETCH = 4096

#: Hexadecimal digits of MD5, SHA-1, Tiger, SHA-2 and SHA-3 digests.
DIGEST_DIGITS = (32, 40, 48, 56, 64, 96, 128)
HEX = re.compile(r"(?:0[xX])?([0-9a-f]+|[0-9A-F]+)")
#: Digests with their algorithm, before the string or at its head.
NAMED_DIGEST = re.compile(r"(?:md5|sha-?\d{1,3}|blake2[bs]|blake3|crc32)[-:=_/\x20\"']{1,3}$", re.IGNORECASE | re.ASCII)
OWN_DIGEST = re.compile(r"(?:md5|sha1|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}")
#: Shapes of identifiers.
IDENTIFIERS = re.compile(
    r"""[0-9a-fA-F]{8}(?:-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}  # UUID
    | [0-9+/_=-]+  # numbers, dates, telephone and card numbers
    | \d{4}-?\d\d-?\d\d[T_-]?[\d-]*Z?  # time stamps
    | [A-Z]{2}\d{13,32}  # account numbers
    | [0-9A-HJKMNP-TV-Z]{26}  # ULID
    | 97[89][0-9-]{10,14}[0-9X]  # ISBN""",
    re.VERBOSE,
)
#: A word, capitalised words run together, or a word with a number behind it.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]*[A-Z][a-z]{2,}|(?<![a-z])[a-z]{2,})+[A-Z]*)\d{0,4}|\d+")
PARTS = re.compile(r"[+/_=-]+")

#: What any span's text holds; a text without it is not looked at again.
LIKELY = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|[A-Za-z0-9+/_-]{16}"""


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and kind (its place in ``KINDS``) of the fixed shapes, by start and kind."""
    found = []
    for kind, (_, shape, group, least) in enumerate(SHAPES):
        found += [(m.start(), m.end(), kind) for m in shape.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], s[2]))


def excluded(s: str, before: str) -> bool:
    """Whether a string is a known digest or identifier, or made of words; ``before`` is the text it follows."""
    digits = HEX.fullmatch(s)
    if digits and len(digits[1]) in DIGEST_DIGITS or OWN_DIGEST.fullmatch(s) or NAMED_DIGEST.search(before) or IDENTIFIERS.fullmatch(s):
        return True
    parts = [x for x in PARTS.split(s) if x]
    return all(len(x) <= WORD_LETTERS and WORDS.fullmatch(x) for x in parts)


def tokens(s: str, vocabulary) -> int:
    return sum(len(vocabulary.encode_ordinary(s[k : k + STRETCH])) for k in range(0, len(s), STRETCH))


def random_spans(text: str, fixed: list[tuple[int, int, int]], vocabulary, min_chars: int, max_ratio: float) -> list[tuple[int, int, int]]:
    """Spans of strings that need many tokens for their length, outside the fixed spans."""
    found, at = [], 0
    covered: list[list[int]] = []
    for s, e, _ in fixed:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    for m in STRING.finditer(text):
        if m.end() - m.start() < min_chars:
            continue
        start = m.start()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        free, k = [], at
        while k < len(covered) and covered[k][0] < m.end():
            s, e = covered[k]
            free.append((start, s))
            start, k = max(start, e), k + 1
        free.append((start, m.end()))
        for s, e in free:
            x = text[s:e]
            if e - s >= min_chars and not excluded(x, text[max(0, s - 12) : s]) and len(x) <= max_ratio * tokens(x, vocabulary):
                found.append((s, e, len(SHAPES)))
    return found


def _scanned(path: str, pattern: str, min_chars: int, max_ratio: float):
    def run(batches):
        vocabulary = encoding(path, pattern)
        for batch in C.chunks(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            likely = pc.match_substring_regex(texts, LIKELY).to_numpy(zero_copy_only=False)
            bounds, flat = [0], []
            for text, look in zip(texts, likely.tolist()):
                if look:
                    fixed = fixed_spans(whole := text.as_py())
                    flat += sorted(fixed + random_spans(whole, fixed, vocabulary, min_chars, max_ratio), key=lambda s: (s[0], s[2]))
                bounds.append(len(flat))
            each = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for _, _, k in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, e, _ in flat], pa.int64())],
                names=["kind", "start", "end"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, vocabulary: str, pattern: str, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row: kind, start and end (code points, end exclusive), by start and kind.

    ``vocabulary`` is a file of token ranks, ``pattern`` how it splits a text.
    """
    if min_chars < MIN_CHARS:
        raise ValueError(f"random strings have {MIN_CHARS} characters or more")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scanned(vocabulary, pattern, min_chars, max_ratio), f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}")


def span_rows(scanned: DataFrame) -> DataFrame:
    """One row ``doc_id, kind, start, end`` per span."""
    return scanned.select("doc_id", F.inline("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    import public_tokenizers

    found = scan(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *[of(kind) for kind in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op11_secret_scan": op11_secret_scan}
#: Token ids are beyond SQL.
ORACLES: dict[str, str] = {}
