"""Structured Streaming: the stateful 5-day bins (``bins``). The row-wise operators of ``petrichor.operators.masks`` and
``petrichor.functions.indices`` contain no aggregation, so they run unchanged on a ``readStream`` frame."""
