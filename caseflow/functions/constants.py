"""Fixed values of the domain: standards, colours, step order, legends.

Standards are (min days, max days). The same role or step has different
standards in different reports, so each report names the table it uses.
"""

from __future__ import annotations

# Parameters of the case-level filter.
DEFAULT_START = "1900-01-01"
DEFAULT_END = "2100-01-01"
ORG_CODES = ("Org 1", "Org 2", "Org 3", "Org 4", "Org 5", "Org 6")

# Case status.
ACTIVE = "Active"
COMPLETED = "Completed"

# Rows or cases from this many days on are outliers.
OUTLIER_DAYS = 1000

# Band of the total time of a case, in days.
CASE_TOTAL_MIN = 12
CASE_TOTAL_MAX = 24

# Length of the "Ticket " prefix of a case number.
CASE_PREFIX_LENGTH = 7

# Role standards of the role duration reports.
ROLE_STANDARDS = {
    "Role 1": (3, 9),
    "Role 2": (2, 4),
    "Role 3": (2, 6),
    "Role 4": (1, 3),
}

# Role standards of the inspector.
INSPECTOR_ROLE_STANDARDS = {
    "Role 2": (3, 9),
    "Role 3": (2, 4),
    "Role 4": (3, 6),
    "Role 5": (1, 3),
}

# Step standards of the step duration report.
STEP_STANDARDS = {
    "Step Display Name 2": (1, 3),
    "Step Display Name 3": (1, 3),
    "Step Display Name 4": (1, 3),
    "Step Display Name 5": (1, 3),
    "Step Display Name 6": (1, 1),
    "Step Display Name 7": (1, 5),
    "Step Display Name 8": (1, 1),
    "Step Display Name 9": (1, 3),
}

# Step standards of the step detail and of the inspector.
DETAIL_STEP_STANDARDS = {
    "Step Display Name 2": (1, 3),
    "Step Display Name 3": (1, 3),
    "Step Display Name 4": (1, 1),
    "Step Display Name 5": (1, 3),
    "Step Display Name 6": (1, 1),
    "Step Display Name 7": (1, 3),
    "Step Display Name 8": (1, 3),
    "Step Display Name 9": (1, 3),
    "Step Display Name 10": (1, 1),
    "Step Display Name 12": (1, 3),
}

# Step standards of the flow diagram.
FLOW_STEP_STANDARDS = {
    "2nd Level Review (Manager)": (1, 3),
    "2nd Level Approval (Manager)": (1, 3),
    "3rd Level Approval (Manager)": (1, 3),
    "Manpower Review": (1, 3),
    "Manpower Approval": (1, 1),
    "Classification Review": (1, 5),
    "Issue Classification Advisory": (1, 1),
    "DCA Finalizes Classification": (1, 3),
}

# On-time limits in days, as (comparison, limit).
ON_TIME_LIMITS = {
    "Step Display Name 1": ("=", 0),
    "2nd Level Review (Manager)": ("<=", 3),
    "2nd Level Approval (Manager)": ("<=", 3),
    "3rd Level Approval (Manager)": ("<=", 3),
    "Manpower Review": ("<=", 3),
    "Manpower Approval": ("<=", 1),
    "Classification Review": ("<=", 5),
    "Issue Classification Advisory": ("<=", 1),
    "DCA Finalizes Classification": ("<", 3),
}

# Role colours (the last one has seven digits).
ROLE_COLORS = {
    "Role 1": "#B7B7C5",
    "Role 2": "#D2D2D2",
    "Role 3": "#D6D6DC",
    "Role 4": "#B7B7C5",
    "Role 5": "#898dadb",
}

# Step colours of the inspector.
STEP_COLORS = {
    "Step Display Name 1": "#2a487b",
    "Step Display Name 2": "#545E82",
    "Step Display Name 3": "#898dadb",
    "Step Display Name 4": "#B7B7C5",
    "Step Display Name 5": "#D6D6DC",
    "Step Display Name 6": "#D2D2D2",
    "Step Display Name 7": "#f1f1f1",
    "Step Display Name 8": "#ffffff",
}

# Step colours of the flow diagram.
FLOW_STEP_COLORS = {
    "Submitted": "#2a487b",
    "2nd Level Review (Manager)": "#545E82",
    "2nd Level Approval (Manager)": "#898dadb",
    "Manpower Review": "#B7B7C5",
    "Manpower Approval": "#D6D6DC",
    "Classification Review": "#D2D2D2",
    "Issue Classification Advisory": "#f1f1f1",
    "DCA Finalizes Classification": "#ffffff",
}

# Order of the steps in the flow diagram.
FLOW_STEPS = (
    "Submitted",
    "2nd Level Review (Manager)",
    "2nd Level Approval (Manager)",
    "3rd Level Approval (Manager)",
    "Manpower Review",
    "Manpower Approval",
    "Classification Review",
    "Issue Classification Advisory",
    "DCA Finalizes Classification",
)
NEXT_STEP = dict(zip(FLOW_STEPS, FLOW_STEPS[1:]))

# Titles and static rows of the inspector legend.
STEP_LEGEND_TITLE = "ASAP Durations by Step (Days)"
TOTAL_LEGEND_TITLE = "Total Time"
ROLE_LEGEND_TITLE = "ASAP Durations by Role (Days)"
TOTAL_LEGEND = {
    "Above Standards": "#719546",
    "Within Standards": "#FCD360",
    "Below Standards": "#A3294D",
    "Active": "#ffffff",
}

# Names of the headline metrics.
TOTAL_REQUESTS = "Total ASAP Requests"
ACTIVE_REQUESTS = "Active ASAP Requests"
COMPLETED_REQUESTS = "Completed ASAP Requests"
AVERAGE_CYCLE_TIME = "Average ASAP Cycle Time - Days"
FASTEST_CYCLE_TIME = "Fastest ASAP Total Cycle Time - Days"
