import zlib
from types import SimpleNamespace

import public_tokenizers
import pytest
from llm_rows import prose
from tokenizers import Tokenizer

import numpy as np

from polarity.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a\n\nb", "  two  blanks ", "tab\t\tx", "nb  sp  x", "\u0085  a b", "don't I'll", "x <|endoftext|> y", "日本 語 テ", "ß ü é é ñ",
       "a\r\nb \r\n c", "1 2  3,4 .5", "\x1c \x1f a", "👍 👍🏽 x", " lead", "trail ", "　 wide 　", "A" * 300]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def whole(tokenizer, text, end=2):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    from polarity.llm.words import text_buffer
    import pyarrow as pa
    encoder = T.PieceEncoder(open(PATH, encoding="utf-8").read())
    texts = [*ODD, None, prose(1, 300), *(a + b for a in ODD for b in ODD)]
    for some in (texts, texts[::-1]):
        ids, count = encoder.encode(*text_buffer(pa.array(some, pa.string())))
        got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == [whole(tokenizer, t)[:-1] for t in some]


def test_files_round_trip(spark, edge_docs, edge_rows, tokenizer, tmp_path):
    rows = sorted(((r[0], r[1]) for r in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    T.write_tokens(edge_docs, f"{tmp_path}/t", PATH, 2)
    docs = T.with_starts(T.read_tokens(spark, f"{tmp_path}/t")).collect()
    docs.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in docs] == [i for i, _ in rows]
    at = 0
    for r, (_, text) in zip(docs, rows):
        want = whole(tokenizer, text)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert (r["start"], r["n_tokens"], r["crc"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_documents_that_span_groups_and_files(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(k, prose(k, 1 + 37 * k % 90)) for k in range(60)]
    ids = [whole(tokenizer, t) for _, t in rows]
    monkeypatch.setattr(T, "GROUP_IDS", 500)
    import pyarrow as pa
    batch = pa.record_batch({"id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})
    given = SimpleNamespace(value=open(PATH, encoding="utf-8").read())
    groups = [b.column(0)[0].as_py() for b in T._write(given, 2, 50_257)(iter([batch]))]
    assert len(groups) > 5
    read = list(T._read(True)(iter([pa.record_batch({"path": ["f"], "content": pa.array([b"\n".join(groups) + b"\n"], pa.binary())})])))
    got = [r for b in read for r in b.to_pylist()]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == ids
    with pytest.raises(ValueError):
        list(T.unpack_groups(groups[0][:200] + b"x" + groups[0][201:]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(T, "FILE_BYTES", 2000)
    T.write_tokens(df, f"{tmp_path}/many", PATH, 2)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in T.with_starts(T.read_tokens(spark, f"{tmp_path}/many", with_ids=False)).collect())
    upto = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert got == [(k, int(upto[k]), len(x)) for k, x in enumerate(ids)]
    assert spark.read.format("binaryFile").load(f"{tmp_path}/many").count() > 3


def test_empty_table(spark, no_docs, tmp_path):
    T.write_tokens(no_docs, f"{tmp_path}/none", PATH, 2)
    assert T.with_starts(T.read_tokens(spark, f"{tmp_path}/none")).collect() == []


def test_added_tokens_in_texts_are_one_id(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    rows = [(1, "x <|endoftext|> y"), (2, "a<|endoftext|>b  <|endoftext|><|endoftext|> \n c <|endoftext"), (3, "|> plain text")]
    want = [whole(plain, t) for _, t in rows]
    assert 50256 in want[0]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/a", PATH, 2)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in T.read_tokens(spark, f"{tmp_path}/a").collect()}
    assert [got[i] for i, _ in rows] == want


def test_no_cut_divides_an_added_token():
    from polarity.llm.words import text_buffer
    from tokenizers import AddedToken
    import pyarrow as pa
    plain = Tokenizer.from_file(PATH)
    plain.add_special_tokens([AddedToken("<| end of text |>"), AddedToken("<cut>", rstrip=True), AddedToken("<é>", lstrip=True)])
    encoder = T.PieceEncoder(plain.to_str(), special_as_text=False)
    marks = [*ODD, "<| end of text |>", "a <cut>  b", "a  <é> b <| end", " of text |> c", "<cut> <| end of text |> x"]
    texts = [a + b for a in marks for b in marks]
    ids, count = encoder.encode(*text_buffer(pa.array(texts, pa.string())))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [whole(plain, t)[:-1] for t in texts]


def test_rows_without_id_are_dealt_to_several_files(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 4000)
    rows = [(None if k % 3 else k, prose(k, 40)) for k in range(120)]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/n", PATH, 2)
    got = T.with_starts(T.read_tokens(spark, f"{tmp_path}/n")).collect()
    assert len({r["file"] for r in got if r["doc_id"] is None}) > 3
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 80 + [k for k, _ in rows if k is not None]
    want = sorted(whole(tokenizer, t) for _, t in rows)
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()


def test_a_word_is_learnt_once_whatever_sign_follows(tokenizer):
    from polarity.llm.words import text_buffer
    import pyarrow as pa
    encoder = T.PieceEncoder(open(PATH, encoding="utf-8").read(), special_as_text=False)
    texts = ["".join(f" zorble{s}" for s in ("", ".", ",", "!", "?", ";", "'s", "'ll", "-x", "_y", "(z)", "9", "\u00e9", "'", "''t")), " zorble.\n", "a'b'sc 'd ''e it's. \t,x"]
    ids, count = encoder.encode(*text_buffer(pa.array(texts, pa.string())))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [whole(tokenizer, t)[:-1] for t in texts]
    known = len(encoder.names)
    again = ["".join(f" zorble{s}" for s in ("?", "!", ";", ".", ","))]
    ids, _ = encoder.encode(*text_buffer(pa.array(again, pa.string())))
    assert ids.tolist() == whole(tokenizer, again[0])[:-1] and len(encoder.names) == known
    encoder.encode(*text_buffer(pa.array([" zorble:"], pa.string())))
    assert len(encoder.names) == known + 1  # the sign only


def test_words_are_cut_only_where_the_tokenizer_cuts(tokenizer):
    from polarity.llm.words import text_buffer
    from tokenizers import AddedToken, pre_tokenizers
    import pyarrow as pa
    texts = [*ODD, "end.of, <|endoftext|>it<|endoftext|> a.b##c ab##", "x-y z"]
    for change in ("prefix", "single", "letters", "signs"):
        t = Tokenizer.from_file(PATH)
        if change == "prefix":
            t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        else:
            t.add_tokens([{"single": AddedToken("##", single_word=True), "letters": AddedToken("of"), "signs": AddedToken("b##c")}[change]])
        encoder = T.PieceEncoder(t.to_str(), special_as_text=False)
        assert encoder.by_words == (change == "signs")
        if change != "prefix":  # pieces were never those of a tokenizer that adds blanks
            ids, count = encoder.encode(*text_buffer(pa.array(texts, pa.string())))
            assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_vocabularies_over_16_bits_keep_their_ids():
    from polarity.llm.words import text_buffer
    import pyarrow as pa
    t = Tokenizer.from_file(PATH)
    t.add_tokens([f"<extra {k}>" for k in range(16_000)])
    encoder = T.PieceEncoder(t.to_str())
    texts = ["a <extra 15999> b.", "<extra 0><extra 15998>"]
    ids, count = encoder.encode(*text_buffer(pa.array(texts, pa.string())))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert max(map(max, want)) > 65_535
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want
