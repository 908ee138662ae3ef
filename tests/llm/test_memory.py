"""What Python workers keep between tasks."""

import public_tokenizers

from chunkmill.llm import alignment, common, sentencepiece_nbest, token_counts


def test_counting_gives_up_the_units_of_a_worker(monkeypatch):
    import pyarrow as pa

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    taken = []

    class Links:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)
            return self

        def groupBy(self, *names):
            return self

        def agg(self, *columns):
            return self

    monkeypatch.setattr(alignment.F, "sum", lambda name: Kept())
    aligner = alignment.aligner_of(a, b)
    assert alignment.aligner_of(a, b) is aligner
    alignment.pair_counts(Links(), a, b)
    assert common._OF_WORKER
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 1], [3]], pa.list_(pa.int32()))], names=["links"])
    (found,) = taken[0](iter([batch]))
    assert found.to_pydict() == {"pair": [1, 3], "n": [2, 1]} and not common._OF_WORKER


class Kept:
    def alias(self, name):
        return self


def test_links_are_counted_by_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[i] for i in range(3 * alignment.ROWS + 1)])], names=["links"])
    parts = list(alignment.slices([batch]))
    assert [p.num_rows for p in parts] == [alignment.ROWS] * 3 + [1]
    assert [x for p in parts for x in p.column(0).flatten().to_pylist()] == list(range(3 * alignment.ROWS + 1))


def test_a_small_cache_gives_the_same_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    small, large = sentencepiece_nbest.Lattice(path, cache=4), sentencepiece_nbest.Lattice(path)
    for text in ("one two three four five six", "seven eight one two", "", "a b c d e f g h"):
        assert list(small.segmentations([text])) == list(large.segmentations([text]))
        assert len(small.known) <= 8
    assert len(large.known) > 8


def test_units_are_cut_once_per_text(monkeypatch):
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    cut, calls = token_counts.units, []
    monkeypatch.setattr(token_counts, "units", lambda t: calls.append(t) or cut(t))
    texts = ["one two", "it's\u3000three \n four", "don't 's"]
    found = [counter.prefixes(t, own).tolist() for t, own in zip(texts, counter.learn_texts(texts))]
    assert calls == texts
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert found == [[len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)] for t in texts]
