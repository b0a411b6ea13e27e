"""tillrec: restaurant sales/settlement reconciliation as Spark jobs.

Every public operator takes and returns DataFrames so that Catalyst sees one
logical plan per job; nothing is collected to the driver.
"""

__version__ = "0.1.0"
