"""The registered queries and, beside each, the SQL it is compared with."""
