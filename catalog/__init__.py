"""Registered queries over the supplied tables, and the SQL that checks them."""
