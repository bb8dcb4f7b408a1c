"""What operators leave in the Python workers that Spark uses again."""

import pandas as pd
import public_tokenizers

from simvane.llm import pieces
from simvane.llm.queries import PIECE_MODEL


def test_tokenizer_leaves_no_model_behind(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(40)], "doc_id long, text string").repartition(4)
    assert pieces.encoding_digests(docs, public_tokenizers.path(PIECE_MODEL)).count() == 40

    def held(batches):
        from simvane.llm import pieces

        for _ in batches:
            yield pd.DataFrame({"n": [len(pieces._MODELS)]})

    assert [r.n for r in spark.range(0, 8, 1, 4).mapInPandas(held, "n long").collect()] == [0] * 4
