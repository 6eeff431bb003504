"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Merges never cross a boundary of the final tokens, so text can be encoded from left to right: a boundary may be emitted
once no text to come can change it. How far to look ahead follows from the merge list alone. Let two texts differ only
after a point. The leftmost boundary in which their segmentations differ moves left only when a rule (a, b) is used in
one and not in the other; b then touches the difference. If the boundary d was made to differ by an earlier rule j, the
next one lies exactly len(left of j) before d, and the rule's right part is the left part of j, or a token that begins
with what j made. ``lookahead`` follows these chains in rank order. Text further than that from the end of the buffer
is stable; it is emitted and forgotten, so memory is one block and the lookahead, however long a word is. Every word
goes through this transducer; ids of words seen before come from a memo of bounded size.

Decoding reads ids only, slice by slice, by a machine with two outputs. The library decodes a file without a decoder by
joining tokens with spaces; the state is whether a token came before. The text itself needs the bytes that the tokens'
letters stand for; the state is the UTF-8 sequence that is still unfinished.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: White space as the tokenizer's normalizer has it.
SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
BLOCK = 512
SLICE = 1 << 16
MEMO = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + other.index(b)) for b in range(256)]


class Rules:
    """A BPE model: ids, ranks of merges and the lookahead that they need."""

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        bpe = spec["model"]
        self.ids: dict[str, int] = bpe["vocab"]
        self.suffix: str = bpe.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in bpe["merges"]]
        self.ranks: dict[tuple[str, str], int] = {m: i for i, m in enumerate(pairs)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pattern: str = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.lookahead = lookahead(pairs, self.suffix)


def lookahead(pairs: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols after a boundary that can still change it; raises if a rule uses a token before it is made."""
    size = lambda t: len(t.removesuffix(suffix)) if suffix else len(t)
    as_left: dict[str, int] = {}
    begun: dict[str, int] = {}
    made: set[str] = set()
    most = 1
    for a, b in pairs:
        if (size(a) > 1 and a not in made) or (size(b) > 1 and b not in made):
            raise ValueError(f"the merge of {a!r} and {b!r} comes before its parts")
        reach = max(size(b), as_left.get(b, 0), begun.get(b, 0))
        most = max(most, reach)
        as_left[a] = max(as_left.get(a, 0), reach + size(a))
        begun[a + b] = max(begun.get(a + b, 0), begun.get(a, 0), reach + size(a))
        made.add(a + b)
    return most


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Plain BPE: the lowest rank first, from left to right."""
    symbols, get, never = list(symbols), ranks.get, len(ranks)
    found = [get(p, never) for p in zip(symbols, symbols[1:], strict=False)]
    while found and (best := min(found)) < never:
        i = found.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = get((symbols[i], symbols[i + 1]), never)
        if i:
            found[i - 1] = get((symbols[i - 1], symbols[i]), never)
    return symbols


class Transducer:
    """Symbols of one word in, stable tokens out."""

    def __init__(self, rules: Rules, block: int = BLOCK) -> None:
        self.rules, self.block, self.held = rules, block, []

    def feed(self, symbols: list[str], last: bool) -> list[str]:
        """The tokens that are stable now. ``last`` ends the word; its final symbol carries the suffix already."""
        suffix, out = self.rules.suffix, []
        for at in range(0, max(1, len(symbols)), self.block):
            self.held += symbols[at : at + self.block]
            if last and at + self.block >= len(symbols):
                out += merge(self.held, self.rules.ranks)
                self.held = []
            elif (stable := len(self.held) - self.rules.lookahead) > self.block:
                used = 0
                for t in merge(self.held, self.rules.ranks):
                    size = len(t.removesuffix(suffix)) if suffix else len(t)
                    if used + size > stable:
                        break
                    used += size
                    out.append(t)
                self.held = self.held[used:]
        return out


class Memo(dict):
    """Words to their ids, or decoded texts. Of bounded size: a full generation becomes the old one, which goes with the
    next; words still in use move on."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        return self.put(word, self.learn(word) if got is None else got)

    def put(self, word: str, got: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


def read_ids(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 4}I", raw)


class Codec:
    """Encodes and decodes whole texts; words seen before come from memos of bounded size."""

    def __init__(self, model: str) -> None:
        self.rules = Rules(model)
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.table = {b: c for b, c in enumerate(self.letters)}
        # White space is in no word, so that the normalizer's folding of its runs changes nothing.
        pattern = self.rules.pattern.replace(r"\s", SPACE)
        self.words = regex.compile(pattern).findall
        #: The same pattern where letters and numbers are plain ranges, for texts up to U+024F.
        letters, numbers = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.plain = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall
        self.wide = re.compile("[^\x00-\u024f]").search
        self.specials = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.rules.special, key=len, reverse=True))) + ")"
        ).split
        self.mark = commonprefix([*self.rules.special])
        self.ids = Memo(self.learn_ids)
        self.raw = {i: t.encode() if t in self.rules.special else self.spell(t) for i, t in self.rules.surface.items()}

    def spell(self, token: str) -> bytes:
        """The bytes that a token's letters stand for; the end of a word is a space."""
        end = bool(self.rules.suffix) and token.endswith(self.rules.suffix)
        return bytes(self.bytes_of[c] for c in (token.removesuffix(self.rules.suffix) if end else token)) + b" " * end

    def tokens(self, word: str) -> list[str]:
        symbols = list(word.encode().decode("latin-1").translate(self.table))
        symbols[-1] += self.rules.suffix
        return Transducer(self.rules).feed(symbols, True)

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words of slices of bounded length, cut before an ASCII space or line break."""
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                cuts = [c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0]
                end = min(cuts, default=len(text))
            part = self.normalize(text[at:end])
            yield (self.words if self.wide(part) else self.plain)(part)
            at = end

    def learn_ids(self, word: str) -> bytes:
        return b"".join(self.rules.ids[t].to_bytes(4, "little") for t in self.tokens(word))

    def digest(self, text: str, keep: list[int] | None = None) -> tuple[int, str, str, str]:
        """Number of ids; SHA-256 of the ids as little-endian 32-bit integers, of their decoding as the library's, and of
        the text that they stand for. ``keep`` gets the ids."""
        ids, joined, plain, n, machine = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), 0, Decoder(self)
        for x in self.stream(text):
            n += len(x) // 4
            ids.update(x)
            some = read_ids(x)
            joined.update(machine.joined(some).encode())
            plain.update(machine.text(some).encode())
            if keep is not None:
                keep += some
        plain.update(machine.close().encode())
        return n, ids.hexdigest(), joined.hexdigest(), plain.hexdigest()

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of one slice after another."""
        ids = self.ids.__getitem__
        for part in self.specials(text) if self.rules.special and self.mark in text else [text]:
            if part in self.rules.special:
                yield self.rules.special[part].to_bytes(4, "little")
                continue
            for words in self.pieces(part):
                if words:
                    yield b"".join(map(ids, words))

    def encode(self, text: str) -> list[int]:
        return [i for x in self.stream(text) for i in read_ids(x)]

    def decode(self, ids: list[int]) -> str:
        """As the library: without a decoder of its own, the tokens are joined by spaces."""
        return Decoder(self).joined(ids)

    def text(self, ids: list[int]) -> str:
        """The text itself: byte letters back to bytes, word ends to spaces, UTF-8 decoded as the bytes come."""
        machine = Decoder(self)
        return machine.text(ids) + machine.close()


class Decoder:
    """Ids in, text out, piece by piece. What it holds: whether a token came before, and an unfinished UTF-8 sequence."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.begun, self.bytes = codec, False, codecs.getincrementaldecoder("utf-8")("replace")

    def joined(self, ids: Sequence[int]) -> str:
        out = " ".join([self.codec.rules.surface[i] for i in ids])
        if self.begun:
            return " " + out
        self.begun = bool(ids)
        return out

    def text(self, ids: Sequence[int]) -> str:
        return self.bytes.decode(b"".join([self.codec.raw[i] for i in ids]))

    def close(self) -> str:
        return self.bytes.decode(b"", True)


@lru_cache(maxsize=2)
def codec_of(model: str) -> Codec:
    """One codec, with its memo, for all tasks that a Python worker runs."""
    return Codec(model)


def encode_documents(
    docs: DataFrame, model: str, *, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256 (of the text that the ids stand for, words
    followed by a space), and ids where ``keep_ids``.

    ``model``: the content of a tokenizers JSON file (read on the driver and sent along; its size does not grow with the
    data). Null texts count as empty: no ids, and the digests of nothing. Very long texts are encoded and decoded in
    slices, very long words in blocks. Repeated rows keep a row each, empty tables give no rows; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids: list[list[int]] = [[] for _ in range(part.num_rows)]
                got = [
                    codec.digest(t or "", i if keep_ids else None)
                    for t, i in zip(part.column(1).to_pylist(), ids, strict=True)
                ]
                n, *digests = zip(*got, strict=True)
                cols = [part.column(0), pa.array(n, pa.int64()), *[pa.array(d, pa.string()) for d in digests]]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256", *["ids"] * keep_ids]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, schema)


def word_model() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), word_model())
