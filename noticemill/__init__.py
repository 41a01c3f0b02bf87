"""Tender-notice analytics as composable DataFrame and Column functions."""
