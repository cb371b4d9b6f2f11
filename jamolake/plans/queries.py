"""Registry of the library's queries and of the SQL they are checked against."""

from . import alignment, arrays, files, names, records, relational, text

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (text, alignment, names, records, arrays, relational, files):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
