import numpy as np
import pyarrow as pa
import pytest
import regex

from gneiss.llm import common as C

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def hashes(text):
    with np.errstate(over="ignore"):
        return C.words(*C.string_parts(pa.array([text])))[0].tolist()


def test_words_of_any_script():
    for a, b in (("ПРИВЕТ", "привет"), ("Žena", "žena"), ("ΣΟΦΙΑ", "σοφια"), ("İ", "i"), ("Ⱥb", "ⱥB"), ("“hi”", "hi"), ("— hi –", "hi"), ("don’t", "don t"), ("été", "ÉTÉ"), ("٣٤", "٣٤"), ("𐐀x", "𐐨X"), ("हिन्दी।", "हिन्दी")):
        assert hashes(a) == hashes(b), (a, b)
    assert len(hashes("a — b")) == 2 and len(hashes("日本語、中文")) == 2 and hashes("a-b") == hashes("a b") != hashes("ab") and hashes("“” — …") == []


def test_words_against_a_regex():
    r = np.random.default_rng(0)
    alphabet = [*"aZ9 -_.,\n", *"éÉßÀ×÷", *"жЖёЁ", *"“”’—… ", *"日語、", *"😀𐐀𐐨", "́", "​", "İ", "ẞ", "K"]
    texts = ["".join(r.choice(alphabet, n)) for n in r.integers(0, 40, 400)]
    with np.errstate(over="ignore"):
        h, first = C.words(*C.string_parts(pa.array(texts)))
    seen = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        want = WORD.findall(pa.compute.utf8_lower(pa.scalar(t)).as_py())
        assert len(want) == b - a, t
        for w, x in zip(want, h[a:b].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_bytes_that_are_not_utf8():
    raw = np.frombuffer(b"ab\xc3 \xff\xfe CD \xe2\x82", np.uint8)
    with np.errstate(over="ignore"):
        h, first = C.words(raw, np.array([0, 5, len(raw)]))
    assert first[-1] == len(h) >= 2


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(Session)


def test_intermediate_tables_can_be_deleted(spark):
    x = C.materialise(spark.range(5), "t")
    path = x.written_to.removeprefix("file://")
    import os

    assert x.count() == 5 and os.path.isdir(path)
    C.discard(x, None)
    assert not os.path.exists(path) and x.written_to not in C._written
