"""veracity.streaming"""
