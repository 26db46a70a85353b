"""contestlake: ranked-competition analytics as Spark jobs.

Every operator takes and returns DataFrames.  ``as_of`` dates, calendars and
thresholds are parameters; nothing reads the clock.
"""
