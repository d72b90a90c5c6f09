"""Training-data operators.

Nothing outside this subpackage imports it.  ``registry`` names the modules
whose ``QUERIES`` and ``ORACLES`` the driver entry picks up.
"""
