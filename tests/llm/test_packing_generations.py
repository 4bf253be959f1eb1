"""How long packing evolves."""

from tidemark.llm import packing


def test_evolution_goes_on_until_nothing_fitter_comes(monkeypatch):
    sizes, children, crossed = [600] * 20 + [300] * 5, [], packing.crossed
    monkeypatch.setattr(packing, "crossed", lambda *a: children.append(1) or crossed(*a))
    best = packing.evolve(sizes, [], 1024, 5)[0]
    assert len(best) == 20 and len(children) >= 24  # the sum alone allows 14 bins
