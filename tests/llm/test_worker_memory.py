"""What a Python worker keeps from one stage to the next."""

import weakref

from tidemark.llm import bpe, packing
from tidemark.llm.common import tidied
from tidemark.llm.queries import vocabulary


def test_a_stage_that_does_not_encode_drops_encoders_of_earlier_ones():
    coder = bpe.encoder(vocabulary(), packing.RankMerger)
    assert list(tidied(iter, encodes=True)([1, 2])) == [1, 2] and bpe.encoder(vocabulary(), packing.RankMerger) is coder
    ids, held = coder.packed("a text"), weakref.ref(coder)
    del coder
    assert list(tidied(iter)([1, 2])) == [1, 2] and held() is None
    assert bpe.encoder(vocabulary(), packing.RankMerger).packed("a text") == ids
