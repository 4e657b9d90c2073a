"""veracity.operators"""
