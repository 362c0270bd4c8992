"""No streaming operator: every result is rebuilt in batch, and refreshes replace partitions
(see ``terrarank.operators.refresh``)."""
