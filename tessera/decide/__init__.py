"""Declarative constrained optimisation over a DataFrame.

    decide(shifts, "DECIDE staff(INT) SUCH THAT staff BETWEEN 2 AND seats MINIMIZE SUM(staff * wage)")

returns df's rows with the chosen values. Data parts of the clauses are computed by Spark as columns; the model is
put together and solved on the driver, within a stated row budget. Selections by a cardinality limit and problems
that no clause couples across rows are solved by Spark itself, whatever the number of rows.
"""

from tessera.decide.api import DecideError, decide, diagnose, explain

__all__ = ["DecideError", "decide", "diagnose", "explain"]
