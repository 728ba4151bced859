"""Operators over whole tables: flatten, search, context, updates, fields, deals, threads, model backends."""
