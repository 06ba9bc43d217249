"""Stateful folds over ordered logs."""
