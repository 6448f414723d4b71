import numpy as np

from quillspan.llm import bits, common


def test_tables_let_nothing_needed_fall_out(spark):
    h = common.mix64(np.arange(4000, dtype=np.uint64))
    rows = np.concatenate([h, h[:500], h[:50], h[:50]]).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in rows], "token long").repartition(5)
    one, two, four = bits.bit_tables(df, lambda pdf: [pdf["token"].to_numpy(np.int64).view(np.uint64)], (1, 2, 4))
    slots = bits.slot_of(h)
    assert bits.test_bits(one, slots).all()
    assert bits.test_bits(two, slots[:500]).all() and bits.test_bits(two, slots).sum() < 520
    assert bits.test_bits(four, slots[:50]).all() and bits.test_bits(four, slots).sum() < 60
    empty = bits.bit_tables(df.where("false"), lambda pdf: [pdf["token"].to_numpy(np.int64).view(np.uint64)], (1,))[0]
    assert not empty.any()
