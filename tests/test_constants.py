"""Every fixed value, written out a second time: a typing error in one place must not pass.

The SQL of the checks takes these tables from the package, so they are pinned here.
"""

import pytest

from caseflow.functions import constants
from caseflow.sources.star_schema import BUSINESS_STEPS

FIXED = {'DEFAULT_START': '1900-01-01',
 'DEFAULT_END': '2100-01-01',
 'ORG_CODES': ('Org 1', 'Org 2', 'Org 3', 'Org 4', 'Org 5', 'Org 6'),
 'ACTIVE': 'Active',
 'COMPLETED': 'Completed',
 'OUTLIER_DAYS': 1000,
 'CASE_TOTAL_MIN': 12,
 'CASE_TOTAL_MAX': 24,
 'CASE_PREFIX_LENGTH': 7,
 'ROLE_STANDARDS': {'Role 1': (3, 9), 'Role 2': (2, 4), 'Role 3': (2, 6), 'Role 4': (1, 3)},
 'INSPECTOR_ROLE_STANDARDS': {'Role 2': (3, 9),
                              'Role 3': (2, 4),
                              'Role 4': (3, 6),
                              'Role 5': (1, 3)},
 'STEP_STANDARDS': {'Step Display Name 2': (1, 3),
                    'Step Display Name 3': (1, 3),
                    'Step Display Name 4': (1, 3),
                    'Step Display Name 5': (1, 3),
                    'Step Display Name 6': (1, 1),
                    'Step Display Name 7': (1, 5),
                    'Step Display Name 8': (1, 1),
                    'Step Display Name 9': (1, 3)},
 'DETAIL_STEP_STANDARDS': {'Step Display Name 2': (1, 3),
                           'Step Display Name 3': (1, 3),
                           'Step Display Name 4': (1, 1),
                           'Step Display Name 5': (1, 3),
                           'Step Display Name 6': (1, 1),
                           'Step Display Name 7': (1, 3),
                           'Step Display Name 8': (1, 3),
                           'Step Display Name 9': (1, 3),
                           'Step Display Name 10': (1, 1),
                           'Step Display Name 12': (1, 3)},
 'FLOW_STEP_STANDARDS': {'2nd Level Review (Manager)': (1, 3),
                         '2nd Level Approval (Manager)': (1, 3),
                         '3rd Level Approval (Manager)': (1, 3),
                         'Manpower Review': (1, 3),
                         'Manpower Approval': (1, 1),
                         'Classification Review': (1, 5),
                         'Issue Classification Advisory': (1, 1),
                         'DCA Finalizes Classification': (1, 3)},
 'ON_TIME_LIMITS': {'Step Display Name 1': ('=', 0),
                    '2nd Level Review (Manager)': ('<=', 3),
                    '2nd Level Approval (Manager)': ('<=', 3),
                    '3rd Level Approval (Manager)': ('<=', 3),
                    'Manpower Review': ('<=', 3),
                    'Manpower Approval': ('<=', 1),
                    'Classification Review': ('<=', 5),
                    'Issue Classification Advisory': ('<=', 1),
                    'DCA Finalizes Classification': ('<', 3)},
 'ROLE_COLORS': {'Role 1': '#B7B7C5',
                 'Role 2': '#D2D2D2',
                 'Role 3': '#D6D6DC',
                 'Role 4': '#B7B7C5',
                 'Role 5': '#898dadb'},
 'STEP_COLORS': {'Step Display Name 1': '#2a487b',
                 'Step Display Name 2': '#545E82',
                 'Step Display Name 3': '#898dadb',
                 'Step Display Name 4': '#B7B7C5',
                 'Step Display Name 5': '#D6D6DC',
                 'Step Display Name 6': '#D2D2D2',
                 'Step Display Name 7': '#f1f1f1',
                 'Step Display Name 8': '#ffffff'},
 'FLOW_STEP_COLORS': {'Submitted': '#2a487b',
                      '2nd Level Review (Manager)': '#545E82',
                      '2nd Level Approval (Manager)': '#898dadb',
                      'Manpower Review': '#B7B7C5',
                      'Manpower Approval': '#D6D6DC',
                      'Classification Review': '#D2D2D2',
                      'Issue Classification Advisory': '#f1f1f1',
                      'DCA Finalizes Classification': '#ffffff'},
 'NEXT_STEP': {'Submitted': '2nd Level Review (Manager)',
               '2nd Level Review (Manager)': '2nd Level Approval (Manager)',
               '2nd Level Approval (Manager)': '3rd Level Approval (Manager)',
               '3rd Level Approval (Manager)': 'Manpower Review',
               'Manpower Review': 'Manpower Approval',
               'Manpower Approval': 'Classification Review',
               'Classification Review': 'Issue Classification Advisory',
               'Issue Classification Advisory': 'DCA Finalizes Classification'},
 'STEP_LEGEND_TITLE': 'ASAP Durations by Step (Days)',
 'TOTAL_LEGEND_TITLE': 'Total Time',
 'ROLE_LEGEND_TITLE': 'ASAP Durations by Role (Days)',
 'TOTAL_LEGEND': {'Above Standards': '#719546',
                  'Within Standards': '#FCD360',
                  'Below Standards': '#A3294D',
                  'Active': '#ffffff'},
 'TOTAL_REQUESTS': 'Total ASAP Requests',
 'ACTIVE_REQUESTS': 'Active ASAP Requests',
 'COMPLETED_REQUESTS': 'Completed ASAP Requests',
 'AVERAGE_CYCLE_TIME': 'Average ASAP Cycle Time - Days',
 'FASTEST_CYCLE_TIME': 'Fastest ASAP Total Cycle Time - Days'}


@pytest.mark.parametrize("name", list(FIXED))
def test_fixed_value(name):
    found = getattr(constants, name)
    assert found == FIXED[name]
    if isinstance(found, dict):
        assert list(found) == list(FIXED[name])


def test_business_steps():
    assert BUSINESS_STEPS == {1: 'Submitted',
     2: '2nd Level Review (Manager)',
     3: '2nd Level Approval (Manager)',
     4: '3rd Level Approval (Manager)',
     5: 'Manpower Review',
     6: 'Manpower Approval',
     7: 'Classification Review',
     8: 'Issue Classification Advisory',
     9: 'DCA Finalizes Classification',
     10: 'Step Display Name 1',
     11: 'Step Display Name 11',
     12: 'Step Display Name 12'}
