"""The mix as its output shards hold it."""

import collections
import re

import numpy as np
from test_learning_and_layout import mixable

from palimpsest.llm import mixing


def test_shards_hold_the_blocks_that_were_drawn_for_them(spark):
    docs, given = mixable(spark)
    source = collections.defaultdict(list)
    for r in given:
        source[r[0]].append(re.findall(mixing.WORD, r[1] or ""))
    rows = mixing.mix_shards(docs, shards=8).collect()
    mix = mixing.Mixture(docs, shards=8)
    slots = {(r.shard, r.slot): r.source_no for r in mix.slots.collect()}
    assert {(r.shard, r.slot) for r in rows} == set(slots)
    drawn = collections.Counter((shard, source) for (shard, _), source in slots.items())
    blocks = [sum(n for (_, s), n in drawn.items() if s == i) for i in range(len(mix.sources))]
    want = mixing.draw_counts(blocks, 8, 1)
    assert all(drawn[shard, i] == want[shard, i] for shard in range(8) for i in range(len(blocks)))
    for shard in range(8):  # slots of a shard are numbered without gaps
        assert sorted(slot for s, slot in slots if s == shard) == list(range(int(np.sum(want[shard]))))
    words, taken = collections.Counter(), collections.Counter()
    for r in rows:
        cut = re.findall(mixing.WORD, r.text)
        assert len(cut) == r.words and any(w[r.skip : r.skip + r.words] == cut for w in source[r.doc_id])
        words[r.shard, r.slot] += r.words
        taken[r.doc_id] += r.words
    assert max(words.values()) <= 64
    report = collections.Counter()
    for r in mixing.mix_report(docs, shards=8).collect():
        report[r.doc_id] += r.taken
    assert taken == +report
