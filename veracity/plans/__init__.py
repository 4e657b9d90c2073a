"""veracity.plans"""
