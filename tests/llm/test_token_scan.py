import glob

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsmood.llm import token_scan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return sorted((r.file, r.doc_no, r.start, r.n_tokens, r.closed) for r in df.collect())


@pytest.mark.parametrize("width,kind", [(2, "<u2"), (4, "<u4")])
@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_files_against_plain_scan(spark, tmp_path, width, kind, block):
    rng, want = np.random.default_rng(1), []
    for k in range(4):
        ids = rng.choice([1, 2, 7, 7, 300], 200 + k).astype(kind) if k else np.empty(0, kind)
        (tmp_path / f"part-{k}").write_bytes(ids.tobytes())
        start, no = 0, 0
        for i, x in enumerate(ids.tolist()):
            if x == 7:
                want.append((k, no, start, i - start, True))
                start, no = i + 1, no + 1
        if start < len(ids):
            want.append((k, no, start, len(ids) - start, False))
    got = rows(token_scan.document_lengths(spark, str(tmp_path), 7, width, block))
    assert [(int(f[-1]), *rest) for f, *rest in got] == want


def test_bytes_that_are_no_ids(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        token_scan.document_lengths(spark, str(tmp_path), 7, 2).collect()


def test_round_trip(spark, make_docs, tmp_path):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    texts = [None, "", "one two", "<|endoftext|>", "Ċ \n x", "long " * 20_000, "one two"]
    path = str(tmp_path / "flat")
    token_scan.write_flat(make_docs(texts).coalesce(1), path, PATH, public_tokenizers.PATTERN, 50256, chunks=2,
                          chunk_bytes=5)
    ids = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) == 2
    flat = b"".join(open(f, "rb").read() for f in files)
    assert np.frombuffer(flat, "<u2").tolist() == [x for i in ids for x in (*i, 50256)]
    got = rows(token_scan.document_lengths(spark, path, 50256, block=10))
    assert [r[3] for r in got] == [len(i) for i in ids]
    assert all(r[4] for r in got)
