import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm import bpe_duckdb, separator_scan, token_planes
from vitrine.llm.pieces import LibraryCoder, _PARTS
from vitrine.shared import run_folder

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


BLANKS = ["don't\nstop.Now 12a½ b½.c", "a.\n\nB", "x_y's 日本.z", "é.É\n", "a\u00adb \u0301c", "a  b", "a \n b", " a", "a ", "a   ", "\n a", "a  b", "a  b", "a\t b  \n\n  c", "", " ", "it 's", "x  \r\n y", "a\x1c b"]


@pytest.mark.parametrize("text", BLANKS)
def test_pieces_encode_like_the_whole_text(library, plain, text):
    assert "".join(_PARTS(text)) == text
    got = np.frombuffer(LibraryCoder(JSON)([text])[0], "<u2").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
    own = bpe_duckdb.Bpe(bpe_duckdb.read_ranks(RANKS), public_tokenizers.PATTERN)
    assert np.frombuffer(own.encode([text])[0], own.type).tolist() == plain.encode_ordinary(text)


def test_bpe_round_trip(hard, hard_rows, plain):
    got = bpe_duckdb.encode_decode(hard, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for row in hard_rows:
        ids = np.array(plain.encode_ordinary(row[1] or ""), "<u4").tobytes()
        want.append((row[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
        assert (row[1] or "").encode() in {bytes(r["decoded"]) for r in got}
    assert sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in got))) == sorted(map(str, want))


def test_words_beyond_the_recursive_query(plain):
    ranks = bpe_duckdb.read_ranks(RANKS)
    for word in ("a" * 129, "thethe" * 60, "qwertyuiop" * 40):
        assert bpe_duckdb.merge_long(word.encode(), ranks) == plain.encode_ordinary(word)


def test_bpe_of_nothing(none):
    assert bpe_duckdb.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_come_back(mode):
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 50257, n).astype("<u2") for n in (0, 1, 7, 64, 65, 1000, 3)]
    file = io.BytesIO()
    writer = token_planes.PlaneWriter(file, "<u2", mode, block=64)
    for i, ids in enumerate(arrays):
        writer.add(i if i != 2 else None, ids)
    writer.close()
    reader = token_planes.PlaneReader(file, len(file.getvalue()))
    assert reader.doc_ids == [0, 1, None, 3, 4, 5, 6] and reader.sizes.tolist() == [len(a) for a in arrays]
    flat = np.concatenate(arrays)
    for start, n in ((0, len(flat)), (63, 2), (60, 300), (len(flat) - 1, 9), (len(flat), 1)):
        assert reader.ids(start, n).tolist() == flat[start:start + n].tolist()
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(file.getvalue()[:-3]), len(file.getvalue()) - 3)


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_token_files(hard, hard_rows, library, mode):
    got = token_planes.round_trip(hard, JSON, mode).orderBy("start").collect()
    want = {}
    for row in hard_rows:
        ids = np.array([*library.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.setdefault(row[0], []).append((len(ids) // 4, zlib.crc32(ids)))
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in hard_rows], key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]


def test_token_files_of_nothing(none):
    assert token_planes.round_trip(none, JSON).count() == 0


def test_separator_scan_of_documents(hard, hard_rows, library):
    got = separator_scan.count_documents(hard, JSON).select("doc_id", "n_tokens", "ended").collect()
    want = [(r[0], 1 + len(library.encode(r[1] or "", add_special_tokens=False).ids), True) for r in hard_rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_across_blocks(spark, block):
    """Documents over many blocks, blocks without a separator, several in one, an open end, an empty file."""
    folder = run_folder(spark, "flat-test")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    files = [[9, 1, 1, 1, 9, 9, *[2] * 40, 9], [5, 5, 5], [], [9], [1, 9, 2]]
    want = []
    for k, ids in enumerate(files):
        with fs.open_output_stream(f"{base}/flat-{k:06d}.ids") as out:
            out.write(np.array(ids, "<u2").tobytes())
        start, no = 0, 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((k, no, start, i + 1 - start, True))
                start, no = i + 1, no + 1
        if start < len(ids):
            want.append((k, no, start, len(ids) - start, False))
    got = separator_scan.scan(spark, folder, "<u2", 9, block).select("file", "doc_no", "start", "n_tokens", "ended")
    assert sorted(map(tuple, got.collect())) == want


def test_separator_scan_keeps_every_id(spark, library):
    """Texts that hold the string of the end of a document keep its ids; the file decodes to the texts."""
    mark = "<|endoftext|>"
    texts = ["plain text", mark, mark * 3, f"a {mark} b{mark}", "", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = separator_scan.count_documents(docs, JSON).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((r["doc_id"], r["n_tokens"], r["ended"]) for r in got) == [(i, len(x) + 1, True) for i, x in enumerate(ids)]
    folder = run_folder(spark, "flat-whole")
    separator_scan.write_flat(docs, folder, JSON)
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/flat-000000.ids") as file:
        flat = np.frombuffer(file.read(), "<u2").tolist()
    assert flat == [x for own in ids for x in (*own, separator_scan.END_ID)]
    back, own = [], []
    for x in flat:
        if x == separator_scan.END_ID:
            back.append(library.decode(own, skip_special_tokens=False))
            own = []
        else:
            own.append(x)
    assert back == [t or "" for t in texts]
    with pytest.raises(Exception, match="is an id of the vocabulary"):
        separator_scan.write_flat(docs, run_folder(spark, "flat-bad"), JSON, 50256)


def test_separator_scan_of_nothing(none):
    assert separator_scan.count_documents(none, JSON).count() == 0


def test_repeated_ids_keep_their_rows(hard):
    assert token_planes.round_trip(hard, JSON).groupBy("doc_id").count().where(F.col("doc_id") == 1).first()["count"] == 3
