"""What Python workers hold from stage to stage of the pipeline."""

import numpy as np

from lumicat.llm import exact_dedup, filters, packing, pii, queries, tokens

from .test_operators import frame


def _workers(spark):
    """A row for each task: whether its worker holds a tokenizer, and shapes of spans."""

    def held(batches):
        import os
        import time

        import pyarrow as pa
        from lumicat.llm import pii, tokens

        for _ in batches:
            pass
        time.sleep(0.3)  # so that all workers get a task
        yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()], pa.int32()), "tokenizers": pa.array([len(tokens._READY)], pa.int32()), "shapes": pa.array([pii._alike.cache_info().currsize], pa.int32())})

    return spark.range(0, 16, 1, 16).mapInArrow(held, "pid int, tokenizers int, shapes int").collect()


def test_workers_drop_tokenizers_and_shapes_in_later_stages(spark):
    docs = frame(spark, [(i, f"text {i % 7} of +1 555 010 99{i} and mail{i}@example.org") for i in range(64)]).repartition(16)
    packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), end_id=1).collect()
    assert any(r.tokenizers for r in _workers(spark))  # from task to task of its stage it stays
    pii.pii_spans(docs).collect()
    assert any(r.shapes for r in _workers(spark))
    for _ in range(2):
        exact_dedup.exact_dedup(docs).collect()
    assert [r for r in _workers(spark) if r.tokenizers or r.shapes] == []


def test_filter_of_pairs(spark):
    rows = [(i * 7919 - 40_000, i % 50 - 25) for i in range(3000)]
    wanted = filters.sent_filter(spark.createDataFrame(rows, "key long, leader long"), len(rows))
    key, i = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    assert wanted.may_hold(filters.pair_key(key, i)).all()
    assert wanted.may_hold(filters.pair_key(key, i + 100)).mean() < 0.05


def test_encoder_memory_follows_what_it_met():
    raw = queries.vocabulary("word_bpe_49k.json")
    e = tokens.Encoder(raw)
    assert e.words.keys.nbytes + e.words.entry.nbytes < 1 << 20
    words = ["w" + f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(40_000)]
    asked = []

    class Counted:
        """The library's tokenizer, with the size of each call."""

        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **more):
            asked.append((len(texts), sum(map(len, texts))))
            return self.of.encode_batch_fast(texts, **more)

    whole, e.single, e.tokenizer = e.tokenizer, Counted(e.single), Counted(e.tokenizer)
    texts = [" ".join(words[k : k + 500]) + " –" * (k % 1000 // 500) for k in range(0, len(words), 500)] * 4
    got = e.encode(texts)
    assert [x.tolist() for x in got[:80]] == [whole.encode(t, add_special_tokens=False).ids for t in texts[:80]]
    assert [x.tolist() for x in got[80:160]] == [x.tolist() for x in got[:80]]
    assert max(n for n, _ in asked) <= tokens.NEW and max(size for _, size in asked) <= tokens.TOGETHER
    assert len(e.words.hashes) > 15_000 and 2 * len(e.words.hashes) <= e.words.slots <= 8 * len(e.words.hashes)


def test_texts_in_runs():
    sizes = [3, 0, 9, 50, 1, 1, 1, 12]
    texts = ["x" * n for n in sizes]
    runs = list(tokens.together(texts, 14))
    assert [t for run in runs for t in texts[run]] == texts
    assert all(sum(len(t) + 1 for t in texts[run]) <= 14 or run.stop - run.start == 1 for run in runs)
    assert list(tokens.together([], 14)) == []
