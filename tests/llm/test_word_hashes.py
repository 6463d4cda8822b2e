import numpy as np
import pyarrow as pa

from tidewater.llm.substring_dedup import Powers, word_hashes, words


def test_equal_words_alone_have_equal_hashes():
    """Whatever texts lie beside them, in slices and with nulls; words are those of words()."""
    rnd = np.random.default_rng(1)
    parts = ["a", "b", "ab", "ba", "aa", "\0", "\0a", "a\0", "é", "日本", "x" * 64, "x" * 65, "x" * 66, "\xa0", "\x1c"]
    for n in (64, 128, 4096):  # words whose polynomials differ by a high power of two
        thue = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        parts += [thue, thue.translate(str.maketrans("ab", "ba"))]
    space = [" ", "\n", "\t\r", "\x0b\x0c  "]
    texts = ["".join(parts[rnd.integers(len(parts))] + space[rnd.integers(4)] * int(rnd.integers(1, 3)) for _ in range(rnd.integers(0, 60))).strip() for _ in range(200)]
    texts += [None, "", "  ", " a", "a ", "a"]
    column = pa.array(texts).slice(3)
    known = {}
    for most in (1, 50, 1 << 20):
        got = list(word_hashes(column, Powers(), most))
        assert len(got) == len(column)
        for t, h in zip(column.to_pylist(), got):
            w = words(t)
            assert len(w) == len(h)
            for x, y in zip(w, h.tolist()):
                assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known) > 15
    assert [len(x) for x in word_hashes(pa.array([None, None], pa.string()), Powers())] == [0, 0]
    assert list(word_hashes(pa.array([], pa.string()), Powers())) == []
