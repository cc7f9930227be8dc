"""DataFrame -> DataFrame operators.

Report operators group by host, and also by ``as_of`` when the frames are tagged
with a report date (``operators.reads.within``). One plan then serves a single
report date or a range of them.
"""
