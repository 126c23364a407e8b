"""terrane.operators"""
