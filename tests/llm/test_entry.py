import __spark_entry__


def test_all_operators_are_registered():
    """A broken import can't make them vanish silently."""
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert {"op2_url_filters", "op8_quality_rules"} <= set(__spark_entry__.oracle_sql())
