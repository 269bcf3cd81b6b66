import os
import random

import numpy as np
import pyarrow as pa

import brute
from tidemark.llm.words import Words, blocks, later_copies, run_hashes


def test_words_of_a_block_are_those_of_each_text():
    rng = random.Random(3)
    for _ in range(300):
        texts = [None if rng.random() < .1 else "".join(rng.choice("ab é\n\t\x0b\x85 Z𝄞") for _ in range(rng.randrange(12)))
                 for _ in range(rng.randrange(6))]
        w = Words(pa.array(["x", *texts], pa.string()).slice(1))
        flat = [x for t in texts for x in brute.words(t)]
        assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)] == flat
        assert len(set(w.hashes().tolist())) == len(set(flat))
        assert w.chars().tolist() == [len(x) for x in flat]
        assert np.diff(w.first).tolist() == [len(brute.words(t)) for t in texts]


def test_blocks_hold_all_rows():
    rows = pa.record_batch({"t": pa.array(["a" * 5, None, "b" * 100, "", "c"])})
    assert [b.num_rows for b in blocks(rows, "t", 6)] == [2, 1, 2]
    assert list(blocks(rows.slice(0, 0), "t", 6)) == []


def test_ngrams_do_not_cross_rows_and_equal_runs_have_equal_hashes():
    w = Words(pa.array(["a b c", "b c", "a b c"]))
    at, g = w.ngrams(w.hashes(), 2)
    assert at.tolist() == [0, 1, 3, 5, 6] and g[1] == g[2] == g[4] and g[0] == g[3] != g[1]
    r = run_hashes(w.hashes(), np.array([0, 5, 1]), np.array([3, 8, 3]))
    assert r[0] == r[1] != r[2]
    later, shared = later_copies(np.array([5, 3, 5, 4], dtype=np.uint64))
    assert later.tolist() == [False, False, True, False] and shared.tolist() == [True, False, True, False]


def test_workers_give_freed_arrays_back_to_the_system(spark):
    from tidemark.llm.queries import WORKER_MEMORY, workers_find_package

    workers_find_package(spark)

    def retained(batches):
        import pyarrow as pa

        def resident():
            return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

        for batch in batches:
            before = resident()
            arrays = [np.ones(1 << 19) for _ in range(60)]  # of 4 MB each; every other one goes first
            kept = arrays[1::2]
            del arrays
            many, least = resident() - before, 8 * len(kept)
            yield pa.record_batch({"ok": pa.array([many < 4 * len(kept) + least and all(os.environ[k] == v for k, v in WORKER_MEMORY.items())])})

    assert spark.range(1).mapInArrow(retained, "ok boolean").first()["ok"]


def test_texts_are_written_in_small_pages_and_read_a_few_rows_at_a_time(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.llm.queries import workers_find_package

    workers_find_package(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    path = str(tmp_path / "texts")
    texts = spark.range(0, 2000, 1, 1).select(F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"/{i}")), 256) for i in range(32))).alias("text"))
    texts.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(next(str(f) for f in (tmp_path / "texts").glob("*.parquet")))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    try:
        column = reader.getFooter().getBlocks().get(0).getColumns().get(0)
        # 4 MB of texts: no page takes more than half a region of a heap of 1 GB or more
        assert reader.readOffsetIndex(column).getPageCount() >= column.getTotalUncompressedSize() // (1 << 19)
    finally:
        reader.close()
    assert spark.read.parquet(path).exceptAll(texts).isEmpty()
