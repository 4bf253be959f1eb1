"""Short lines and lines on five sites are boilerplate too."""

import pytest

from tidemark.llm import linededup


@pytest.mark.parametrize("most", [linededup.BROADCAST_LINES, 0])
def test_short_lines_and_lines_of_five_sites(spark, monkeypatch, most):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", most)
    short, long = "All rights reserved.", " ".join(f"word{k}" for k in range(60))
    rows = [(i, "\n".join([f"own text {i}", "Les." if i < 4 else "other " + str(i), short, long, "", "end of " + str(i)]), f"s{i % 5}") for i in range(9)]
    done = {r["doc_id"]: r for r in linededup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert short in done[0]["text"] and long in done[0]["text"]
    assert all(done[i]["_n_removed"] == 2 and short not in done[i]["text"] and long not in done[i]["text"] for i in range(1, 9))
    assert all("Les." in done[i]["text"] for i in range(4))  # on four sites only
