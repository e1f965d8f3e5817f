"""Streaming.

The reference workload has no streaming operators (no watermarks, windows
or state).  Every geometry function in :mod:`geoq.functions` is a
stateless Catalyst expression and every spatial join in
:mod:`geoq.operators.spatial_join` is a plain equi-join, so both apply
unchanged to a streaming DataFrame joined with a static one (e.g. a stream
of points against a static polygon layer); nothing here adds state.
"""
