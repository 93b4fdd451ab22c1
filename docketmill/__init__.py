"""Document analytics written as DataFrame plans.

sources    readers that turn bytes, text, HTML and mail into typed tables
functions  column functions shared by the operators
operators  checks, extraction, comparison and relational state over those tables
plans      whole queries, with the SQL that must return the same rows
streaming  the same folds over Structured Streaming
"""
