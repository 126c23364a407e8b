"""terrane.plans"""
