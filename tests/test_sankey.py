from caseflow.operators import sankey
from caseflow.operators.scope import Scope
from caseflow.plans import reports
from hand_rows import as_set

COMPLETED = {
    ("Submitted", 3),
    # Step id 2 also belongs to a visit of another case: both rows join.
    ("2nd Level Review (Manager)", 1),
    ("2nd Level Approval (Manager)", 2),
    ("Issue Classification Advisory", 1),
    (None, 1),
    ("Manpower Approval", 1),
    ("Classification Review", 1),
}
RUNNING = {
    ("Manpower Approval", 1),
    ("2nd Level Review (Manager)", 2),
    ("DCA Finalizes Classification", 1),
    ("3rd Level Approval (Manager)", 1),
    ("Side Step", 1),
}


def test_latest_completed_visit(flow_steps):
    found = as_set(sankey.latest_completed_visit(flow_steps))
    assert ("2nd Level Review (Manager)", "Ticket 1", 3) in found
    assert (None, "Ticket 6", 15) in found
    assert len(found) == 10


def test_counts(flow_steps):
    assert as_set(sankey.completed_by_step(flow_steps)) == COMPLETED
    assert as_set(sankey.in_progress_by_step(flow_steps)) == RUNNING


def test_repeated_step_id_reaches_out_of_scope(flow_steps):
    # Only Ticket 9 is in scope; its step id 2 also marks a visit of Ticket 1.
    found = as_set(sankey.completed_by_step(flow_steps, Scope(orgs=["Org 5"])))
    assert found == {("Manpower Approval", 1), ("2nd Level Review (Manager)", 1)}


def test_nodes(flow_steps):
    nodes = as_set(sankey.sankey_nodes(flow_steps))
    assert len(nodes) == len(COMPLETED) + len(RUNNING)
    assert {
        ("Submitted", "Submitted (3)", "#2a487b", None, None),
        ("Classification Review", "Classification Review (1)", "#D2D2D2", 1, 5),
        (None, " (1)", None, None, None),
        ("Side Step In Progress", "Side Step (1)", None, None, None),
        ("Manpower Approval In Progress", "Manpower Approval (1)", "#D6D6DC", 1, 1),
    } <= nodes


def test_links(flow_steps):
    links = sankey.sankey_links(flow_steps)
    assert links.columns == ["from", "to", "width"]
    assert as_set(links) == {
        ("Submitted", "2nd Level Review (Manager)", 3),
        ("2nd Level Review (Manager)", "2nd Level Approval (Manager)", 1),
        ("2nd Level Approval (Manager)", "3rd Level Approval (Manager)", 2),
        ("Issue Classification Advisory", "DCA Finalizes Classification", 1),
        (None, None, 1),
        ("Manpower Approval", "Classification Review", 1),
        ("Classification Review", "Issue Classification Advisory", 1),
    } | {(step, f"{step} In Progress", width) for step, width in RUNNING}


def test_report_from_persisted_counts(flow_steps):
    counts = sankey.flow_counts(flow_steps).persist()
    try:
        report = reports.sankey_diagram(flow_steps, counts=counts)
        assert as_set(report["node_data_array"]) == as_set(sankey.sankey_nodes(flow_steps))
        assert as_set(report["link_data_array"]) == as_set(sankey.sankey_links(flow_steps))
    finally:
        counts.unpersist()
