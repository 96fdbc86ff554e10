"""BPE encoding by prefix-sharing trie traversal, and decoding.

Only distinct words are encoded. In sorted order their shared prefixes are neighbours, so one walk over them is a
depth-first walk of their trie: a stack keeps the state of every node on the current path, and a prefix that many words
share is computed once. The state of a node is the last token of its prefix's encoding. It is the one token that ends
the prefix and may follow the last token of what is before it; two tokens may stand side by side if no merge across
their border comes before the merges that made them.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import ChainMap
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices

#: Bytes that a generation of what a worker remembers takes, of words and of runs of text between spaces each.
REMEMBERED = 72_000_000
#: Longer runs and words are encoded whenever they occur.
LONG = 128
NEVER = 1 << 62
#: Text on which normalising is lower-casing alone, and on which Python and the library agree about letters.
PLAIN = re.compile("[!-~\nÀ-ÖØ-öø-ÿ]*")


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte: itself where it has one, else the next free one from 256 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Encoder:
    """A BPE vocabulary file of the tokenizers library: byte-level words, with or without a word-end mark.

    The library's own normaliser and pre-tokeniser cut a text into words; the merges are done here."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain BPE is supported")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError(f"{path}: decoders and post-processors are not supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must match literally")
        self.library = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.symbol = byte_symbols()
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        #: The file's own pattern, where its steps are the ones that PLAIN is about.
        self.pattern = regex.compile(split[0]["pattern"]["Regex"]) if normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["invert"] and split[0]["behavior"] == "Removed" and not split[1]["use_regex"] and not split[1]["add_prefix_space"] else None
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.birth: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            made, x, y = vocab[a + b], vocab[a], vocab[b]
            if made in self.birth or r <= max(self.birth.get(x, -1), self.birth.get(y, -1)):
                raise ValueError(f"{path}: merge {r} is not in the order of its parts")
            self.birth[made], self.parts[made] = r, (x, y)
        # a token ends a word if its last part does; `made` of other merges may look alike as text
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        last: dict[int, bool] = {}
        whole: dict[int, bool] = {}
        for t, i in sorted(vocab.items(), key=lambda x: self.birth.get(x[1], -1)):
            if i in self.parts:
                x, y = self.parts[i]
                last[i], whole[i] = last[y], whole[x] and whole[y] and not self._crossed(x, y, self.birth[i])
            else:
                last[i], whole[i] = bool(suffix) and len(t) > len(suffix) and t.endswith(suffix), True
            if whole[i]:
                (self.final if last[i] else self.inner)[t.removesuffix(suffix) if last[i] else t] = i
        if not suffix:
            self.final = self.inner
        #: Of each ending of three symbols, the length of the longest token that ends so.
        self.reach = [{}, {}]
        for reach, tokens in zip(self.reach, (self.inner, self.final)):
            for t in tokens:
                reach[t[-3:]] = max(reach.get(t[-3:], 0), len(t))
        self.fits: dict[tuple[int, int], bool] = {}

    def _crossed(self, x: int, y: int, before: int = NEVER) -> bool:
        """Whether a merge across the border of two neighbours comes before their own merges are done, or before `before`."""
        rank, birth, parts = self.rank, self.birth, self.parts
        left = right = before  # when x and y are absorbed
        while True:
            m = rank.get((x, y))
            if m is not None and m < left and (m <= right if right != before else m < right):
                return True
            bx, by = birth.get(x, -1), birth.get(y, -1)
            if bx < 0 and by < 0:
                return False
            if bx > by:
                left, x = bx, parts[x][1]
            else:
                right, y = by, parts[y][0]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each distinct word, in sorted order."""
        token, size = [0], [0]  # of the prefix at each depth: its last token and that token's length
        inner, final, fits = self.inner, self.final, self.fits
        inner_reach, final_reach = self.reach
        before = ""
        for word in sorted(words):
            n = len(word)
            if not n:
                yield word, []
                continue
            shared = len(os.path.commonprefix((before, word)))
            depth = min(shared, n - 1)
            del token[depth + 1 :], size[depth + 1 :]
            before = word[: n - 1]
            for d in range(depth + 1, n + 1):
                table, reach = (final, final_reach) if d == n else (inner, inner_reach)
                for k in range(min(d, reach.get(word[d - 3 : d] if d > 3 else word[:d], 2)), 0, -1):
                    t = table.get(word[d - k : d])
                    if t is None:
                        continue
                    if k == d:
                        break
                    pair = (token[d - k], t)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = not self._crossed(*pair)
                    if ok:
                        break
                else:
                    raise ValueError(f"{word[:40]!r} holds a symbol that the vocabulary lacks")
                if d < n:
                    token.append(t)
                    size.append(k)
            ids, d = [t], n - k
            while d:
                ids.append(token[d])
                d -= size[d]
            ids.reverse()
            if len(fits) > 150_000:
                fits.clear()
            yield word, ids

    def words(self, text: str) -> list[str]:
        """Byte-level words of a text without added tokens."""
        if self.pattern is not None:
            if text.isascii() and text.isalpha():  # letters are one word, whatever else the pattern tells apart
                return [text.lower()]
            if PLAIN.fullmatch(text):
                found = self.pattern.findall(text.lower())
                return found if text.isascii() else ["".join([self.symbol[b] for b in w.encode()]) for w in found]
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str | int]:
        """Words, and ids of added tokens, in order."""
        if self.splitter is None or not any(t in text for t in self.added):
            return self.words(text)
        return [x for part in self.splitter.split(text) if part for x in ([self.added[part]] if part in self.added else self.words(part))]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does without a decoder: tokens with a space between."""
        return " ".join(map(self.text.__getitem__, ids))


class Known(dict):
    """Encodings by string, in two generations: what is asked for again outlives the older one. A generation is bounded in
    bytes: `held` counts what its strings and encodings take, with their objects."""

    def __init__(self) -> None:
        self.older: dict = {}
        self.held = 0

    def keep(self, fresh: dict[str, bytes]) -> None:
        self.update(fresh)
        self.held += 220 * len(fresh) + 2 * sum(map(len, fresh)) + sum(map(len, fresh.values()))

    def age(self, most: int) -> None:
        if self.held > most:
            self.older, self.held = dict(self), 0
            self.clear()

    def lacking(self, wanted: set[str]) -> set[str]:
        """Those of the wanted strings that neither generation has; the rest is in the younger one after this."""
        wanted = wanted - self.keys()
        again = wanted & self.older.keys()
        if again:
            self.keep({x: self.older[x] for x in again})
        return wanted - again


class Memory:
    """Encodings that a worker has made so far: of words, and of runs of text between spaces. Long ones are not kept."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.word, self.run, self.most = Known(), Known(), REMEMBERED
        self.brief: dict[str, bytes] = {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The texts cut at spaces, after every distinct run in them is known."""
        cut = [t.split(" ") for t in texts]
        self.word.age(self.most)
        self.run.age(self.most)
        # a text without added tokens has none in its runs
        pieces = self.encoder.pieces if any(a in t for a in self.encoder.added for t in texts) else self.encoder.words
        fresh = {r: pieces(r) for r in self.run.lacking(set().union(*cut))}
        wanted = self.word.lacking({w for ws in fresh.values() for w in ws if isinstance(w, str)})
        made = {w: array("I", ids).tobytes() for w, ids in self.encoder.encode_words(wanted)}
        long = {w: made.pop(w) for w in wanted if len(w) > LONG}
        self.word.keep(made)
        word = self.word if not long else ChainMap(long, self.word)
        runs = {r: word[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else b"".join([word[w] if isinstance(w, str) else array("I", [w]).tobytes() for w in ws]) for r, ws in fresh.items()}
        self.brief = {r: runs.pop(r) for r in fresh if len(r) > LONG}
        self.run.keep(runs)
        return cut

    def ids(self, cut: list[str]) -> bytes:
        """Ids of a text that learn() has just cut."""
        if self.brief:
            return b"".join([self.brief[r] if len(r) > LONG else self.run[r] for r in cut])
        return b"".join(map(self.run.__getitem__, cut))


def memory(path: str) -> Memory:
    kept = held("bpe")
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[path] = Memory(path)
    return kept[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, decoded text) of each row of docs.

    The file must drop white space between words, so that no token crosses a space. A null or empty text has no ids and
    decodes to an empty text. Added tokens in a text are matched as the library does. Rows and ids may repeat or be null.
    Other columns of docs are not read. remembered: bytes of a generation of a worker's memory, REMEMBERED if not given; there are
    two generations of words and two of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = memory(path)
        own.most = remembered or REMEMBERED
        for b in batches:
            for piece in slices(b, "text"):
                cuts = own.learn([t or "" for t in piece.column("text").to_pylist()])
                ids = [own.ids(cut) for cut in cuts]
                decoded = [own.encoder.decode(array("I", x)) for x in ids]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op3: ids and decoded text of every document, as digests. path: the vocabulary file."""
    import public_tokenizers

    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("word_bpe_49k.json")))
