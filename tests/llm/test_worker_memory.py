from merchantry.llm import byte_bpe, worker_memory


def test_a_lean_task_drops_other_operators_tables():
    """Else the token tables of a pipeline's last stage stay in the workers while its other stages run."""
    made = []
    table = worker_memory.worker_table(lambda path: made.append(path) or path)
    assert [table("a"), table("a"), table("b")] == ["a", "a", "b"] and made == ["a", "b"]
    assert list(worker_memory.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert table.cache_info().currsize == 0
    assert table("a") == "a" and made == ["a", "b", "a"]


def test_token_tables_are_among_them():
    assert byte_bpe._encoder in worker_memory._tables and byte_bpe._codec in worker_memory._tables
