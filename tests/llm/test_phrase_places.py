import numpy as np
import pyarrow as pa

from geotide.llm import substring_dedup
from geotide.llm.words import words


def test_a_phrase_is_compiled_once_per_shard(monkeypatch):
    """Places of one phrase in a shard, two texts of one id among them, are one key of the automaton."""
    phrase = " ".join(f"w{k}" for k in range(25))
    texts = [f"{'x ' * k}{phrase} tail{k}" for k in range(30)]
    ids = np.arange(30) // 2
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = words(np.frombuffer("".join(texts).encode(), np.uint8), at)
    numbers = np.unique(w.hash, return_inverse=True)[1] + 1
    h = substring_dedup._run_hashes(w, np.array([0]), np.array([25])).view(np.int64)[0]
    places = [(h, int(i), k, 25, 0, 0) for k, i in enumerate(ids)] + [(h, 99, 0, 25, 0, 0), (h, 3, 10 ** 6, 25, 0, 0), (h + 1, 4, 8, 25, 0, 0)]
    patterns = pa.table({c: pa.array(v) for c, v in zip(("p", "id", "start", "len", "f_id", "f_start"), zip(*places))})
    added, machine = [], substring_dedup.ahocorasick.Automaton

    class Spy:
        def __init__(self, *kind):
            self.of = machine(*kind)

        def add_word(self, key, value):
            added.append((key, value))
            return self.of.add_word(key, value)

        def __len__(self):
            return len(self.of)

        def __getattr__(self, name):
            return getattr(self.of, name)

    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Spy)
    docs = pa.table({"id": ids, "text": texts, "doc_id": ids})
    out = substring_dedup._stream(20, docs, patterns).to_pydict()
    assert added == [(tuple(numbers[:25].tolist()), (25, 0, 0))]
    assert out["n_words"] == [k + 26 for k in range(30)] and out["n_removed"] == [0] + [25] * 29
