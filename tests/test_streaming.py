import numpy as np

import blockframe
from blockframe.preprocessing import StandardScaler
from blockframe.streaming import apply_to_stream


def test_scaler_on_a_stream(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(20, 3))
    a = blockframe.array(x)
    scaler = StandardScaler().fit(a)
    a.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.df.schema).parquet(str(tmp_path / "in"))
    out = apply_to_stream(stream, "row_idx", "features", 3, scaler.transform)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.row_idx: r.features for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    np.testing.assert_allclose([got[i] for i in range(20)], (x - x.mean(0)) / x.std(0))


def test_names():
    assert all(callable(getattr(blockframe, n)) for n in blockframe.__all__)
