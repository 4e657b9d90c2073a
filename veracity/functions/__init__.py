"""veracity.functions"""
