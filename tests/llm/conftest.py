"""Order of the tests: the one that starts a cluster of its own comes before the shared session is there."""


def pytest_collection_modifyitems(items):
    items.sort(key=lambda item: "test_pipeline_run" not in item.nodeid)
