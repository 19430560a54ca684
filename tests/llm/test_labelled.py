import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm.labelled import labelled_sample


def test_labels_without_document_take_no_places(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 400, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 == 0 or i % 20 > 0)) for i in range(400)], "doc_id long, toxic int")
    encode = lambda d: d.select("doc_id", F.col("text").cast("binary").alias("encoded"))
    texts, y, shift = labelled_sample(docs, labels, "toxic", 10, 99, 10, encode)
    assert len(texts) == 20 and y.sum() == 10 and np.isclose(shift, 0)
