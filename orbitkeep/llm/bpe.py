"""BPE encoding and decoding by batched numpy merge rounds.

Words of many texts are merged together: their symbols lie in one flat array,
every round looks all neighbouring pairs up by binary search over the sorted
pair keys, and merges in each word the pair of the lowest rank, wherever it
stands.  Words met before come from a bounded cache, so rounds run over new
words only.  The cache has a word's ids as bytes of int32; texts of ids are
joined from them by Arrow.

The vocabulary is a tokenizer file (JSON) of the word-end kind: normalised by
NFC and lower case, split by a pattern, bytes mapped to printable characters,
"</w>" on each word's last symbol, no decoder.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: Words that a Python worker remembers at most.
CACHE_WORDS = 200_000
#: Characters of text that are split before their new words are merged.
BATCH_CHARS = 1 << 21
#: Rows whose texts are Python strings at once, besides those that are being split.
ROWS = 256
END = "</w>"
NONE = np.int64(1 << 40)
#: White space of the split pattern, Latin-1 first.
SPACES = r"\t-\r \x85\xa0" + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable character of each byte: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.special = special
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.cut = regex.compile("|".join(f"(?:{regex.escape(t)})" for t in sorted(special, key=len, reverse=True))) if special else None
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("\\s", SPACES)).findall
        # the same for texts within Latin-1, whose letters and numbers can be listed
        listed = [(k, "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == k)) for k in "LN"]
        for k, own in listed:
            pattern = pattern.replace(f"[\\p{{{k}}}]", f"[{own}]").replace(f"\\p{{{k}}}", own)
        self.latin_words = re.compile(pattern.replace("\\s", SPACES[:14])).findall
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + END] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.shift = np.int64(max(self.tokens).bit_length())
        keys = np.array([(vocab[a] << int(self.shift)) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a part is made before it is used, and in one way: then all places of a pair can be merged at once
        born = dict(zip(made.tolist(), range(len(pairs)), strict=True))
        if len(born) != len(pairs) or any(born.get(vocab[x], -1) >= r for r, p in enumerate(pairs) for x in p):
            raise ValueError("merges are not in the order of their parts")
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.cache: dict[str | int, bytes] = {}
        every = range(max(self.tokens) + 1)
        self.names, self.numbers = pa.array(map(self.tokens.get, every), pa.string()), pa.array(map(str, every), pa.string())

    def rank_of(self, a: np.ndarray, b: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where there is no merge or not ``inside`` one word."""
        pair = (a << self.shift) | b
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & inside, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as int32."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[bytes] = [None] * len(words)  # type: ignore[list-item]
        rank = np.append(self.rank_of(symbols[:-1], symbols[1:], owner[:-1] == owner[1:]), NONE)[: len(symbols)]
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, first)
            bounds = np.append(first, len(symbols))
            final = np.flatnonzero(low == NONE)
            ids = symbols.astype(np.int32).tobytes()
            for k, a, b in zip(owner[first[final]].tolist(), (4 * first[final]).tolist(), (4 * bounds[final + 1]).tolist(), strict=True):
                done[k] = ids[a:b]
            per = np.repeat(low, np.diff(bounds))
            hit = np.flatnonzero((rank == per) & (per != NONE))
            if not len(hit):
                break
            # of overlapping places (a a a) every second one, from the left
            run = np.concatenate([[True], np.diff(hit) > 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            changed = np.zeros(len(symbols), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True
            keep = per != NONE
            keep[hit + 1] = False
            # the place before a merged pair may itself be the dropped half of the pair before
            before = hit[(hit > 1)] - 2
            changed[before] = True
            symbols, owner, rank, changed = symbols[keep], owner[keep], rank[keep], changed[keep]
            at = np.flatnonzero(changed)
            after = np.minimum(at + 1, len(symbols) - 1)
            rank[at] = self.rank_of(symbols[at], symbols[after], (owner[at] == owner[after]) & (at < after))
        return done

    def split(self, text: str) -> list:
        """Words of a text, and ids of special tokens that stand in it."""
        if self.cut is None:
            return self.plain(text)
        out: list = []
        at = 0
        for m in self.cut.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:]) if at else self.plain(text)

    def plain(self, text: str) -> list[str]:
        own = self.normal(text)
        try:
            own.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(own)
        return self.latin_words(own)

    @staticmethod
    def normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, split: list[list]) -> None:
        """Put the words' ids into the cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.cache]
        words = [w for w in new if isinstance(w, str)]
        self.cache.update(zip(words, self.merge(words), strict=True))
        self.cache.update((w, np.int32(w).tobytes()) for w in new if not isinstance(w, str))

    def ids(self, split: list[list]) -> pa.ListArray:
        """Ids of texts whose words are in the cache."""
        own = [b"".join(map(self.cache.__getitem__, words)) for words in split]
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(own), np.int32)))

    @staticmethod
    def joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
        """The names of each row's ids, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names.take(ids.values)), " ")

    def batches(self, texts: Iterable[str]):
        """Lists of split texts whose words are in the cache."""
        part, size = [], 0
        for t in texts:
            part.append(self.split(t))
            size += len(t)
            if size >= BATCH_CHARS:
                self.learn(part)
                yield part
                part, size = [], 0
        if part:
            self.learn(part)
            yield part

    def encode(self, text: str) -> list[int]:
        [part] = self.batches([text])
        return self.ids(part).values.to_pylist()

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_made: dict[str, Bpe] = {}


def _of(spec: str) -> Bpe:
    """One per Python worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(spec)
    return _made[key]


def _strings(column: pa.Array) -> Iterator[str]:
    for i in range(0, len(column), ROWS):
        yield from column.slice(i, ROWS).fill_null("").to_pylist()


def _runner(spec, make, place: int | None):
    """place: of the text within the row, None if it comes beside the row."""
    shared = spec

    def run(batches):
        bpe = _of(shared.value)
        for batch in batches:
            rows, at = batch.column(0), 0
            for part in bpe.batches(_strings(batch.column(1) if place is None else rows.field(place))):
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(part)), *make(bpe, part)], names=["row", *make.names])
                at += len(part)

    return run


def _ids(bpe: Bpe, part: list[list]) -> list[pa.Array]:
    ids = bpe.ids(part)
    return [ids, bpe.joined(ids, bpe.names)]


def _digests(bpe: Bpe, part: list[list]) -> list[pa.Array]:
    ids = bpe.ids(part)
    sha = lambda x: pa.array([hashlib.sha256(s).hexdigest() for s in x.cast(pa.binary()).to_pylist()], pa.string())
    return [pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), sha(bpe.joined(ids, bpe.numbers)), sha(bpe.joined(ids, bpe.names))]


_ids.names = ["ids", "decoded"]
_digests.names = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _run(docs: DataFrame, path: str, columns, text: str, make, types: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # on the driver; about 2 MB, sent to each executor once
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(text).alias("text"))
    schema, place = rows.schema["row"].dataType.simpleString(), None
    if text in columns:  # texts go to the workers once
        rows, place = rows.select("row"), columns.index(text)
    return rows.mapInArrow(_runner(spec, make, place), f"row {schema}, {types}")


def tokenized(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) and decoded (text); columns of those names are replaced.

    Null and empty texts have no ids and an empty decoded text.  Special tokens
    that stand in a text are single ids.  Whole texts are encoded, rows stay in
    place and no column is lost; an empty table gives no rows.  As the result is
    computed after this call, the session's Arrow batches end at 4 MB from then
    on, unless it has a limit of its own.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    out = _run(docs, path, kept, text, _ids, "ids array<int>, decoded string")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "ids", "decoded")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: digests of what ``tokenized`` gives."""
    out = _run(docs, path, [id_col], text, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("row")[id_col].alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
