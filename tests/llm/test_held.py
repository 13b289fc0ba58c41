from panelwright.llm import held as h


def test_one_operator_at_a_time():
    h._held.clear()
    made = []
    make = lambda name: lambda: made.append(name) or [name]
    first = h.held("a", make("a"))
    assert h.held("a", make("a")) is first and made == ["a"]
    assert h.held("b", make("b")) == ["b"] and list(h._held) == ["b"]
    assert h.held("a", make("a")) is not first and made == ["a", "b", "a"]
    h._held.clear()


def test_memory_taken_by_building_is_given_back(monkeypatch):
    h._held.clear()
    log = []
    monkeypatch.setattr(h, "_give_back", lambda: log.append("back"))
    h.held("a", lambda: log.append("made"))
    h.held("a", lambda: log.append("again"))
    assert log == ["back", "made", "back"]
    h._held.clear()
