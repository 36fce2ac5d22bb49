from newsloom.llm import licenses

NAMED = "licenced undr the gnu general public licence"
RENAMED = "licensed under the gnu genral public license"


def test_notices_side_by_side_are_all_found():
    search = licenses.NoticeSearch(licenses.NOTICES)
    # The better match stands behind, and its name is changed.
    assert search(f"{NAMED} and {RENAMED}") == [("gpl", 0, 44, 3)]
    assert search(f"{RENAMED} and {NAMED}") == [("gpl", 49, 93, 3)]
    exact = "licensed under the gnu general public license"
    assert search(f"{NAMED} {exact} {NAMED}") == [("gpl", 0, 44, 3), ("gpl", 45, 90, 0), ("gpl", 91, 135, 3)]
    assert len(search(" ".join([NAMED, RENAMED, exact] * 10))) == 20
    assert search(" ".join([RENAMED] * 10)) == []
