"""Training-data operators. Nothing outside this subpackage imports it.

Each module holds one general operator; ``queries`` holds the thin ``opN_`` queries over the driver's tables and
``oracle`` the SQL of those that SQL can express.
"""
