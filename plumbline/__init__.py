"""Find and fix slow Spark work across a whole fleet of event logs.

``sources``   event logs, file listings, generated tables, table telemetry
``functions`` column formatters and the distributed exact median
``operators`` roll-ups, rules, advice, comparison, reports, joins, layout, reuse
``plans``     the registered queries and the SQL they are checked against
"""
