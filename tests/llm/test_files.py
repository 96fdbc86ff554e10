"""Tokens, token-id files and archives: equality with the library, exact round trips, odd rows."""

import gzip
import hashlib
import io
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from helpers import DOCS, ODD, SF, odd_documents
from tokenizers import Tokenizer

from gridwright.llm import bpe, tokenids, warc

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "abcdeABCXYZ0123456789 .,'!?-<>|/_\n\t\r\x0b\x1c\x85\xa0　 İΣςßéèñ̈́中文한국어🙂👍🏽ﬁ½²​᠎﻿Джक्ष"


def strange(n, seed):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    out += ["".join(rnd.choice("aaaabbthe er in") for _ in range(60)) for _ in range(n // 4)]
    out += ["".join(chr(rnd.choice([rnd.randint(32, 0x2FFF), rnd.randint(0x3000, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(n // 4)]
    return out + ["x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext", "it's  don't 's"] + [t or "" for t in ODD]


def test_trie_encodes_as_the_library():
    library, own = Tokenizer.from_file(WORDS), bpe.Memory(WORDS)
    for text in strange(1500, 0):
        (cut,) = own.learn([text])
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.ids(cut) == np.array(ids, "<u4").tobytes(), text[:60]
        assert library.decode(ids, skip_special_tokens=False) == own.encoder.decode(ids)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5000)
    monkeypatch.setattr(tokenids, "REMEMBERED", 5000)
    texts = strange(100, 3)
    words, ids = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    own, other = bpe.Memory(WORDS), tokenids.Tokens(BYTES)
    for t in texts:
        (cut,) = own.learn([t])
        assert own.ids(cut) == np.array(words.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert other.encode([t])[0].tolist() == ids.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded_in_bytes(monkeypatch):
    """Texts without spaces, and very many different words: a generation holds what it may, and a batch more at most."""
    most = 400_000
    monkeypatch.setattr(bpe, "REMEMBERED", most)
    monkeypatch.setattr(tokenids, "REMEMBERED", most)
    rnd = random.Random(5)
    own, other = bpe.Memory(WORDS), tokenids.Tokens(BYTES)
    size = lambda known: sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for k, v in known.items())
    for n in range(60):
        long = "".join(rnd.choice("abcdefgh") for _ in range(4000))
        many = " ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(200))
        for text in (long, many):
            own.learn([text])
            other.encode([text])
        for known in (own.word, own.run, other.word, other.first, other.later):
            assert size(known) < 1.5 * most and size(known.older) < 1.5 * most
            assert all(len(k) <= bpe.LONG for k in known)


def test_encode_rows(spark):
    library = Tokenizer.from_file(WORDS)
    for r in bpe.encode(odd_documents(spark), WORDS).collect():
        if r.doc_id is not None and r.doc_id not in (0, 3):
            ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
            assert (r.n_tokens, bytes(r.ids)) == (len(ids), np.array(ids, "<u4").tobytes())
    assert bpe.encode(odd_documents(spark).limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        bpe.Encoder(BYTES)


def test_bytes_encode_as_the_library():
    library, own = Tokenizer.from_file(BYTES), tokenids.Tokens(BYTES)
    for text in strange(1500, 1):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("n", [1, 7, 1024])
def test_blocks(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        ids = (rng.integers(0, 2 ** rng.integers(1, 33), (3, n)) * (rng.random((3, n)) < rng.random())).astype("<u4")
        for block, row in zip(tokenids.pack(ids), ids):
            assert (tokenids.unpack(block, n) == row).all()
    # outliers cost their own place, not everyone's width
    rare = np.full((1, 1024), 3, "<u4")
    rare[0, 5] = 1 << 31
    assert len(tokenids.pack(rare)[0]) < 40


def test_file_reads_any_document(tmp_path):
    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 60000, k).astype("<u4") for k in (0, 1, 5000, 3, 300_000, 0, 1024)]
    out = io.BytesIO()
    w = tokenids.Writer(out)
    for i, x in enumerate(lists):
        w.add(i if i else None, x)
    w.close()
    (tmp_path / "f").write_bytes(out.getvalue())
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as file:
        r = tokenids.Reader(file)
        got = list(r.documents(4000))
        assert [g[0] for g in got] == [None, 1, 2, 3, 4, 5, 6] and all((g[2] == x).all() for g, x in zip(got, lists))
        assert (r.ids(7, 12) == np.concatenate(lists)[7:12]).all()


def test_ids_of_documents(spark):
    library, start = Tokenizer.from_file(BYTES), 0
    rows = {r.doc_id: r for r in tokenids.query(spark, SF).collect()}
    for d in spark.read.parquet(DOCS).orderBy("doc_id").collect():
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 0]
        assert (rows[d.doc_id].start, rows[d.doc_id].n_tokens) == (start, len(ids))
        assert rows[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_ids_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    manifest = tokenids.write_ids(docs, BYTES, f"file://{tmp_path}/ids")
    got = tokenids.read_ids(manifest, f"file://{tmp_path}/ids").orderBy("start").collect()
    assert len(got) == docs.count() and got[0].doc_id is None and got[0].start == 0
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(got, got[1:]))
    none = tokenids.write_ids(docs.limit(0), BYTES, f"file://{tmp_path}/none")
    assert tokenids.read_ids(none, f"file://{tmp_path}/none").count() == 0


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    long = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    pages = [(1, "http://a/ b\r\nX: y", long), (4, None, long), (9, "u", long), (2, "u", "short"), (3, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (None, "u", "only" * 400), (9, "u", long), (7, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, bytes int, digest string")
    index, target = warc.archive(df)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, target).collect()), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html == long and i != 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=str)
    fs, base = pa.fs.FileSystem.from_uri(target)
    names = {r.file for r in index.collect()}
    assert len(names) > 2 and {f.base_name for f in fs.get_file_info(pa.fs.FileSelector(base))} == names | {n + warc.SIDECAR for n in names}
    for name in names:
        whole = fs.open_input_file(f"{base}/{name}").read()
        rows = sorted((r.offset, r.length) for r in index.where(index.file == name).collect())
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:] + [(len(whole), 0)]))
        for at, n in rows:
            assert gzip.decompress(whole[at : at + n]).startswith(b"WARC/1.1\r\n")
    index, target = warc.archive(df.limit(0))
    assert warc.read_records(index, target).count() == 0


def test_inflating():
    rng = np.random.default_rng(0)
    parts = [b"", b"a", bytes(5_000_000), rng.bytes(700_000)]
    data = b"".join(gzip.compress(p) for p in parts)
    chunks = lambda data: (data[i : i + 70_000] for i in range(0, len(data), 70_000))
    assert b"".join(warc.inflate(chunks(data))) == b"".join(parts)
    assert max(len(p) for p in warc.inflate(chunks(data))) <= warc.PIECE
    with pytest.raises(ValueError):
        list(warc.inflate(chunks(data[:-9])))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))


